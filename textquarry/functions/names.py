"""Names that languages and their usual libraries bring along; calls of them resolve to no user code."""

from __future__ import annotations

#: Fixed values, by language, in natural order: the names that call resolution skips.
JAVASCRIPT = """
console log error warn info debug
require import export
setTimeout setInterval clearTimeout clearInterval
fetch JSON parse stringify
Array Object String Number Boolean Map Set
Promise resolve reject then catch finally
parseInt parseFloat isNaN isFinite
encodeURIComponent decodeURIComponent encodeURI decodeURI
Math Date RegExp Error
document window navigator location history
addEventListener removeEventListener querySelector querySelectorAll
createElement getElementById getElementsByClassName
"""
PYTHON = """
print len range str int float bool list dict
tuple set frozenset bytes bytearray memoryview
type isinstance issubclass callable hasattr getattr
setattr delattr property classmethod staticmethod
super object id hash repr ascii bin hex oct
chr ord format vars dir help input
open file read write close readline readlines
abs divmod pow round min max sum sorted reversed
enumerate zip map filter reduce any all next iter
slice complex eval exec compile globals locals
breakpoint exit quit
append extend insert remove pop clear index count
sort copy keys values items get update setdefault
split join strip lstrip rstrip replace find rfind
startswith endswith upper lower title capitalize
format encode decode
raise Exception BaseException ValueError TypeError
KeyError IndexError AttributeError ImportError RuntimeError
sleep time datetime path exists join makedirs
"""
GO = """
append cap close complex copy delete imag len
make new panic print println real recover
Println Printf Print Sprintf Fprintf Errorf
Scan Scanf Scanln Sscan Sscanf
Read Write Close Seek ReadAll WriteString
Error Unwrap Is As
Background TODO WithCancel WithTimeout WithDeadline WithValue
String Bytes Len Cap
int int8 int16 int32 int64
uint uint8 uint16 uint32 uint64
float32 float64 complex64 complex128
string bool byte rune
"""
JAVA = """
toString equals hashCode getClass clone finalize
notify notifyAll wait
println print printf format exit gc
currentTimeMillis nanoTime arraycopy
length charAt substring indexOf lastIndexOf
startsWith endsWith contains replace replaceAll
split trim toLowerCase toUpperCase isEmpty isBlank
valueOf compareTo concat matches
add remove get set size isEmpty contains
clear iterator toArray addAll removeAll retainAll
put containsKey containsValue keySet values entrySet
stream filter map flatMap reduce collect
forEach findFirst findAny anyMatch allMatch noneMatch
sorted distinct limit skip count
of ofNullable empty isPresent ifPresent orElse orElseGet
parseInt parseDouble parseFloat parseLong
intValue doubleValue floatValue longValue
getMessage printStackTrace getCause initCause
"""
RUST = """
println print eprintln eprint format panic
assert assert_eq assert_ne debug_assert
vec format_args write writeln
Some None unwrap unwrap_or unwrap_or_else unwrap_or_default
expect is_some is_none map map_or map_or_else
and_then or_else ok_or ok_or_else take replace
Ok Err is_ok is_err ok err
iter iter_mut into_iter next collect filter map
fold reduce for_each enumerate zip chain
take skip peekable flatten flat_map
any all find position count sum product
min max min_by max_by cloned copied
push pop len is_empty capacity reserve
clear insert remove swap_remove retain
first last get get_mut
to_string to_owned as_str as_bytes chars bytes
trim trim_start trim_end split split_whitespace
contains starts_with ends_with replace to_lowercase to_uppercase
clone default from into try_from try_into
as_ref as_mut borrow borrow_mut
deref deref_mut drop
new lock read write try_lock try_read try_write
await poll
"""


def builtin_names() -> frozenset[str]:
    """Names that no call is resolved by, whatever its language."""
    return frozenset(name for names in (JAVASCRIPT, PYTHON, GO, JAVA, RUST) for name in names.split())
