"""Byte-level BPE by a finite-state transducer that is compiled from the merges while texts are read.

A sequence of tokens is what the merges make of its bytes if and only if that holds for each two neighbours: up to the first
merge over a border, either side runs as it would alone, so what crosses there crosses for the two alone as well. So the
encoding of a prefix is the encoding of a shorter one and one more token, and which one follows from trie walks and pair tests.
That makes a transducer: a hypothesis is a place at which a next token may begin, with the trie node that the bytes since then
have reached and the tokens that lead to the place. A state is the set of live hypotheses, less the tokens that they share,
which are put out: a token is put out as soon as no continuation can change it, at most the longest token's length behind.
States and moves are made when first met (lazy determinisation); beyond MOST_STATES the machine forgets them and starts anew.

Pair tests do not merge whole strings: each token's own merges are known as the order in which its edge parts grow, and two
such orders are walked side by side until a merge over the border is due or none is left.

A text is cut by the pattern first, each match is encoded by itself, and a match that is an entry of the rank file as a whole
is that entry. A space after anything but white space always begins a match, so chunks from one such space to the next are
encoded once and remembered; a text with white space before a space is encoded whole. Decoding is a stream too: whole characters are given out, and up to three bytes wait.

Defined cases: a null or empty text has no tokens; every row gives a row, also with repeated or null ids; bytes that are
no UTF-8 are read as U+FFFD; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.llm.common import small_batches, text_or_empty
from textquarry.llm.spaces import RUN, laid_out, space_chunks
from textquarry.llm.token_files import pieces, tokenizer_path

#: States and pair tests that the machine holds before it forgets them; chunks of text, and bytes of them and their ids, that a worker
#: remembers; longer chunks it does not.
MOST_STATES, MOST_PAIRS, MOST_CHUNKS, MOST_CHUNK_BYTES, LONG_CHUNK = 400_000, 1_000_000, 900_000, 40 << 20, 200
NEVER = 1 << 62


class Transducer:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.child: dict[int, int] = {}
        self.token_at: list[int] = [-1]
        for token, rank in ranks.items():
            node = 0
            for b in token:
                node = self.child.setdefault(node << 8 | b, len(self.token_at))
                if node == len(self.token_at):
                    self.token_at.append(-1)
            self.token_at[node] = rank
        self.inner = bytearray(len(self.token_at))
        for key in self.child:
            self.inner[key >> 8] = 1
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.edges: dict[int, tuple | None] = {}
        self.pairs: dict[int, bool] = {}
        self._forget()

    def _forget(self) -> None:
        #: (state << 8 | byte) to (output << 32 | next state); outputs and states by number. State 0 is the beginning of a match.
        self.moves: dict[int, int] = {}
        self.outputs: list[tuple] = [()]
        self.output_of: dict[tuple, int] = {(): 0}
        self.live: list[tuple] = [((0, -1, ()),)]
        self.state_of: dict[tuple, int] = {self.live[0]: 0}

    def _edges(self, token: int) -> tuple | None:
        """The token's own merges in order: (rank of the next merge, left edge part, right edge part); None if they do not end in it."""
        if token not in self.edges:
            whole = self.bytes_of[token]
            parts, order = [whole[i : i + 1] for i in range(len(whole))], []
            while True:
                due = min(((self.ranks.get(a + b, NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))), default=(NEVER, 0))
                order.append((due[0], parts[0], parts[-1]))
                if due[0] == NEVER:
                    break
                parts[due[1] : due[1] + 2] = [parts[due[1]] + parts[due[1] + 1]]
            self.edges[token] = tuple(order) if len(parts) == 1 else None
        return self.edges[token]

    def stand(self, a: int, b: int) -> bool:
        """Whether tokens a and b stay apart side by side; a = -1 is the beginning of a match."""
        key = a << 32 | b
        if key not in self.pairs:
            if len(self.pairs) >= MOST_PAIRS:
                self.pairs.clear()
            self.pairs[key] = self._edges(b) is not None if a < 0 else self._stand(self._edges(a), self._edges(b))
        return self.pairs[key]

    def _stand(self, left: tuple | None, right: tuple | None) -> bool:
        if left is None or right is None:
            return False
        i = j = 0
        while True:  # the least rank is merged first, of equal ones the leftmost
            (mine, _, x), (theirs, y, _) = left[i], right[j]
            over = self.ranks.get(x + y, NEVER)
            if mine <= over and mine <= theirs:
                if mine == NEVER:
                    return True
                i += 1
            elif over <= theirs:
                return False
            else:
                j += 1

    def _move(self, state: int, b: int) -> int:
        """Make the move; beyond MOST_STATES all others are forgotten first, and the numbers of states with them."""
        live, done, child, pairs = [], None, self.child.get, self.pairs
        for node, last, waiting in self.live[state]:
            node = child(node << 8 | b)
            if node is None:
                continue
            token = self.token_at[node]
            if done is None and token >= 0:
                apart = pairs.get(last << 32 | token)
                if apart if apart is not None else self.stand(last, token):
                    done = (0, token, (*waiting, token))
            if self.inner[node]:
                live.append((node, last, waiting))
        live.append(done)  # the last hypothesis begins here, and its tokens spell all that was read
        first, shared = live[0][2], 0
        while shared < len(first) and all(len(h[2]) > shared and h[2][shared] == first[shared] for h in live):
            shared += 1
        if len(self.live) >= MOST_STATES:
            self._forget()
            state = -1
        then, out = tuple([(n, t, w[shared:]) for n, t, w in live] if shared else live), first[:shared]
        number = self.state_of.setdefault(then, len(self.live))
        if number == len(self.live):
            self.live.append(then)
        kind = self.output_of.setdefault(out, len(self.outputs))
        if kind == len(self.outputs):
            self.outputs.append(out)
        if state >= 0:
            self.moves[state << 8 | b] = kind << 32 | number
        return kind << 32 | number

    def stream(self, parts: Iterable[bytes]) -> Iterator[int]:
        """Tokens of one match that comes in parts, each as soon as it is certain (the whole match is not looked up)."""
        state = 0
        for part in parts:
            for b in part:
                move = self.moves.get(state << 8 | b)
                if move is None:
                    move = self._move(state, b)
                state = move & 0xFFFFFFFF
                yield from self.outputs[move >> 32]
        yield from self.live[state][-1][2]

    def encode(self, match: bytes) -> list[int]:
        """Tokens of one match of the pattern."""
        whole = self.ranks.get(match)
        if whole is not None:
            return [whole]
        state, tokens, known, outputs = 0, [], self.moves.get, self.outputs
        for b in match:
            move = known(state << 8 | b)
            if move is None:
                move = self._move(state, b)
                known, outputs = self.moves.get, self.outputs
            state = move & 0xFFFFFFFF
            if move > 0xFFFFFFFF:
                tokens += outputs[move >> 32]
        tokens += self.live[state][-1][2]
        return tokens


class Utf8Stream:
    """Bytes in, bytes of whole characters out: a machine over (bytes still due, least and greatest next byte).

    Broken sequences are given out as they are; only what may still become a character waits."""

    def __init__(self):
        self.waiting = b""

    def feed(self, data: bytes | memoryview) -> bytes | memoryview:
        data = self.waiting + bytes(data) if self.waiting else data
        cut = len(data) - self._open(data)
        self.waiting = bytes(data[cut:])
        return data[:cut]

    def finish(self) -> bytes:
        out, self.waiting = self.waiting, b""
        return out

    @staticmethod
    def _open(data: bytes) -> int:
        """Length of the unfinished character at the end; the machine starts at the last byte that begins one."""
        for back in range(1, min(3, len(data)) + 1):
            lead = data[-back]
            if lead & 0xC0 != 0x80:
                break
        else:
            return 0
        due, least, greatest = (1, 0x80, 0xBF) if 0xC2 <= lead <= 0xDF else (2, {0xE0: 0xA0}.get(lead, 0x80), {0xED: 0x9F}.get(lead, 0xBF)) if 0xE0 <= lead <= 0xEF else (3, {0xF0: 0x90}.get(lead, 0x80), {0xF4: 0x8F}.get(lead, 0xBF)) if 0xF0 <= lead <= 0xF4 else (0, 0, 0)
        for b in data[len(data) - back + 1 :]:
            if not due or not least <= b <= greatest:
                return 0
            due, least, greatest = due - 1, 0x80, 0xBF
        return back if due else 0


class Codec:
    """Encodes texts and decodes ids by one rank file. Of patterns other than the one that the files come with, texts are not cut at spaces."""

    def __init__(self, ranks: str, pattern: str | None):
        import public_tokenizers
        import regex

        with open(tokenizer_path(ranks), "rb") as f:
            table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.machine, self.matches = Transducer(table), regex.compile(pattern or public_tokenizers.PATTERN).findall
        self.odd = RUN if pattern is None else "(?s)."
        top = max(self.machine.bytes_of) + 1
        self.token = pa.array([self.machine.bytes_of.get(i, b"") for i in range(top)], type=pa.large_binary())
        self.decimal = pa.array([b"%d," % i for i in range(top)], type=pa.large_binary())
        self.known: dict[str, bytes] = {}
        self.known_bytes = 0

    def _ids(self, chunk: str) -> bytes:
        found = self.known.get(chunk)
        if found is None:
            ids = array("I")
            for match in self.matches(chunk):
                ids.extend(self.machine.encode(match.encode()))
            found = ids.tobytes()
            if len(chunk) <= LONG_CHUNK:
                if len(self.known) >= MOST_CHUNKS or self.known_bytes >= MOST_CHUNK_BYTES:
                    self.known.clear()
                    self.known_bytes = 0
                self.known[chunk] = found
                self.known_bytes += len(chunk) + len(found)
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids, and where each text's end."""
        chunks, _, codes, per_text = space_chunks(texts, self.odd)
        packed, ends = laid_out(list(map(self._ids, chunks)), codes)
        return np.frombuffer(packed, dtype="<u4"), np.concatenate([[0], ends])[per_text] // 4

    def decode(self, ids: np.ndarray, most: int = 1 << 20) -> Iterator[bytes]:
        """The bytes of ids, in pieces that end with whole characters."""
        stream = Utf8Stream()
        for at in range(0, len(ids), most):
            yield stream.feed(laid_out(self.token, ids[at : at + most])[0])
        yield stream.finish()

    def digests(self, ids: np.ndarray, most: int = 1 << 20) -> tuple[str, str]:
        """Hashes of the decimal ids joined by commas, and of the bytes that decoding gives."""
        spelt, back = hashlib.sha256(), hashlib.sha256()
        for at in range(0, len(ids), most):
            part = laid_out(self.decimal, ids[at : at + most])[0]
            spelt.update(part if at + most < len(ids) else part[:-1])
        for piece in self.decode(ids, most):
            back.update(piece)
        return spelt.hexdigest(), back.hexdigest()


@lru_cache(maxsize=2)
def codec(ranks: str, pattern: str | None) -> Codec:
    return Codec(ranks, pattern)


def _texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).cast("long").alias("k"), F.make_valid_utf8(text_or_empty(text)).alias("t"))


def encode_texts(docs: DataFrame, *, key: str = "doc_id", text: str = "text", ranks: str = "byte_bpe_multi_50k.tiktoken", pattern: str | None = None) -> DataFrame:
    """Every row's key and its token ids. A map over the rows: nothing is shuffled, a task holds a few MB of texts."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in pieces(it, 4 << 20):
            ids, ends = codec(ranks, pattern).encode(texts)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), type=pa.int32()), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array(keys, type=pa.int64()), lists], names=[key, "ids"])

    with small_batches(docs.sparkSession):
        return _texts(docs, key, text).mapInArrow(run, f"{key} long, ids array<int>")


def decode_ids(rows: DataFrame, *, key: str = "doc_id", ids: str = "ids", ranks: str = "byte_bpe_multi_50k.tiktoken") -> DataFrame:
    """Every row's key and the text that its ids spell. Ids that the file does not have spell nothing, broken characters are U+FFFD."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(ranks, None)
        for batch in it:
            texts = []
            for x in batch.column(1):
                known = np.array([i for i in x.as_py() or [] if i is not None and 0 <= i < len(coder.token)], dtype=np.uint32)
                texts.append("".join(bytes(piece).decode("utf-8", "replace") for piece in coder.decode(known)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, type=pa.string())], names=[key, "text"])

    with small_batches(rows.sparkSession, 100):
        return rows.select(F.col(key).cast("long").alias(key), F.col(ids).alias("i")).mapInArrow(run, f"{key} long, text string")


def round_trip_digests(docs: DataFrame, *, key: str = "doc_id", text: str = "text", ranks: str = "byte_bpe_multi_50k.tiktoken", pattern: str | None = None) -> DataFrame:
    """Per row: n_tokens, the hash of its decimal ids joined by commas, and that of the bytes that decoding the ids gives."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(ranks, pattern)
        for keys, texts in pieces(it, 4 << 20):
            ids, ends = coder.encode(texts)
            starts = np.concatenate([[0], ends[:-1]])
            both = [coder.digests(ids[i:j]) for i, j in zip(starts, ends)]
            columns = [pa.array(keys, type=pa.int64()), pa.array(ends - starts, type=pa.int64()), *(pa.array(list(c), type=pa.string()) for c in zip(*both))]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])

    with small_batches(docs.sparkSession):
        return _texts(docs, key, text).mapInArrow(run, f"{key} long, n_tokens long, ids_sha256 string, decoded_sha256 string")
