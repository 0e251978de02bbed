from pyspark.sql import functions as F

from textquarry.functions import predicates as P
from textquarry.functions import text as X


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "s string").select(f(F.col("s")).alias("x")).first().x


def test_identifier_variations(spark):
    assert one(spark, "getUserName", X.identifier_variations) == ["getusername", "get", "user", "name", "get_user_name"]
    assert one(spark, "get_user_name", X.identifier_variations) == ["get_user_name", "get", "user", "name", "getusername"]


def test_paths(spark):
    assert one(spark, "a/./b/../c", X.normal_path) == "a/c"
    assert one(spark, "../../x", X.normal_path) == "x"
    assert one(spark, "src/a.test.ts", X.suffix) == ".ts"
    assert one(spark, ".env", X.suffix) == ""


def test_sensitive_paths(spark):
    bad = ["a/.env", "a/.ENV", ".env.staging", "x/.ssh/known", "k.pem", "id_rsa", "app/application-dev.yaml", "my_service-account-1.json", "credentials.json"]
    good = [".env.example", "id_rsa.pub", "k.pem.pub", "src/env.ts", "application.ts"]
    assert all(one(spark, p, P.is_sensitive) for p in bad)
    assert not any(one(spark, p, P.is_sensitive) for p in good)


def test_test_files(spark):
    assert all(one(spark, p, P.is_test_file) for p in ["a/__tests__/b.ts", "x.spec.ts", "tests/a.py", "src/test_a.py", "a_test.go"])
    assert not any(one(spark, p, P.is_test_file) for p in ["src/testing.ts", "src/a.ts", "contest_x.py"])


def test_escapes(spark):
    assert one(spark, "x </file > <FILE a='1'> <p>", X.escape_tags) == "x <\\/file > <\\FILE a='1'> <p>"
    assert one(spark, "\x1b[31mred\x1b[0m\rx\x07\ty\n", X.plain_terminal_text) == "redx\ty\n"
    assert one(spark, "a<b>&'\"", X.escape_xml) == "a&lt;b&gt;&amp;&apos;&quot;"


def test_summary(spark):
    assert one(spark, "short", X.summary_text) == "short"
    text = "A" * 300 + ".\n\n" + "B" * 300
    assert one(spark, text, X.summary_text) == "A" * 300 + "."


def test_json_comments(spark):
    assert one(spark, '{ // c\n "a": 1, /* b */ }', X.strip_json_comments).replace(" ", "").replace("\n", "") == '{"a":1}'


def test_failures(spark):
    kinds = {"usage limit reached": "rate-limit", "quota was exceeded": "rate-limit", "rate limit": "rate-limit", "ECONNRESET": "transient", "status code: 503": "retryable", "504 Gateway Timeout": "retryable", "HTTP 404": "permanent", "server overloaded": "permanent", "": "permanent"}
    assert {m: one(spark, m, X.error_class) for m in kinds} == kinds
    assert one(spark, "EPIPE", lambda c: X.is_retryable(c, F.lit(None))) and not one(spark, "EACCES", lambda c: X.is_retryable(c, F.lit("no")))


def test_language_hints(spark):
    assert [one(spark, p, X.language_hint) for p in ("a/b.TSX", "c.hpp", "Makefile", "x.y.yml", "z.zzz")] == ["tsx", "cpp", "", "yaml", ""]
