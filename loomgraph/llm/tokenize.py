"""Encoding of a corpus with a public byte-level BPE tokenizer, vectorised, without regular expressions.

The pre-tokenizer is a finite automaton over classes of code points. The texts of a batch are laid end to end as one array
of classes; each code point is a transition function on the automaton's states, and because composition of functions is
associative the states everywhere follow from a blocked prefix scan of compositions (numpy, no loop over characters). The
boundaries are read off the states. The slices between them are merged by rank, through a cache of pieces seen before.

Byte offsets of the tokens can be kept, so that any token leads back to its place in the text; decode() inverts encode().
"""

from __future__ import annotations

import base64
import heapq
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.runtime import read

#: Vocabulary as ranks; a parameter of every operator here.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Pieces kept in the cache of a worker, and the longest piece that is kept.
CACHE_PIECES, CACHE_LENGTH = 300_000, 48
#: Characters that are scanned at once (a longer text is scanned alone).
SCAN_CHARS = 500_000

# classes of code points
LETTER, SDMT, EL, VEE, AR, EE, NUMBER, OTHER, APOSTROPHE, SPACE, WHITE, TEXT_START = range(12)
# states: what the scan is in after a code point; A*: a match that began with an apostrophe
BEGIN, IN_L, IN_N, IN_O, IN_W, IN_P, A, A_L, A_V, A_R, DONE = range(11)
#: White space by the Unicode property, fixed values.
WHITE_SPACE = [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def _classes() -> np.ndarray:
    table = np.full(0x110000, OTHER, np.uint8)
    for cp in range(0x110000):
        kind = unicodedata.category(chr(cp))[0]
        if kind == "L":
            table[cp] = LETTER
        elif kind == "N":
            table[cp] = NUMBER
    table[WHITE_SPACE] = WHITE
    for chars, cls in (("sdmt", SDMT), ("l", EL), ("v", VEE), ("r", AR), ("e", EE), ("'", APOSTROPHE), (" ", SPACE)):
        table[[ord(c) for c in chars]] = cls
    return table


def _transitions() -> np.ndarray:
    """[class, state] -> state."""
    t = np.zeros((12, 11), np.uint8)
    for c in (LETTER, SDMT, EL, VEE, AR, EE):
        t[c] = IN_L
    t[SDMT, A] = DONE
    t[EL, A], t[EL, A_L] = A_L, DONE
    t[VEE, A], t[EE, A_V] = A_V, DONE
    t[AR, A], t[EE, A_R] = A_R, DONE
    t[NUMBER], t[OTHER], t[SPACE], t[WHITE], t[TEXT_START] = IN_N, IN_O, IN_P, IN_W, BEGIN
    t[APOSTROPHE] = A
    t[APOSTROPHE, [IN_O, IN_P, A]] = IN_O
    return t


def _starts() -> np.ndarray:
    """[class, state before] -> whether a piece begins here, before looking ahead."""
    s = np.ones((12, 11), bool)
    for c in (LETTER, SDMT, EL, VEE, AR, EE):
        s[c, [IN_L, IN_P, A_L, A_V, A_R]] = False
    s[NUMBER, [IN_N, IN_P]] = False
    s[OTHER, [IN_O, IN_P, A]] = False
    s[APOSTROPHE, [IN_O, IN_P, A]] = False
    s[SPACE, [IN_W, IN_P]] = False
    s[WHITE, [IN_W, IN_P]] = False
    return s


_TABLES: dict[str, np.ndarray] = {}
TRANSITIONS, STARTS = _transitions(), _starts()


def class_table() -> np.ndarray:
    if "classes" not in _TABLES:
        _TABLES["classes"] = _classes()
    return _TABLES["classes"]


def scan_states(classes: np.ndarray, block: int = 64) -> np.ndarray:
    """State after each position, from BEGIN: an exclusive scan of function compositions over blocks, then within them."""
    n = len(classes)
    if n == 0:
        return np.zeros(0, np.uint8)
    if n <= block:
        columns, starts = np.ascontiguousarray(classes[:, None]), np.zeros(1, np.uint8)
    else:
        count = -(-n // block)
        padded = np.full(count * block, TEXT_START, np.uint8)
        padded[:n] = classes
        columns = np.ascontiguousarray(padded.reshape(count, block).T)
        whole = np.tile(np.arange(11, dtype=np.uint8), (count, 1))
        for c in columns:
            whole = TRANSITIONS[c[:, None], whole]
        starts = np.zeros(count, np.uint8)
        starts[1:] = _prefix(whole[:-1])
    states = np.empty(columns.shape, np.uint8)
    for i, c in enumerate(columns):
        starts = TRANSITIONS[c, starts]
        states[i] = starts
    return states.T.reshape(-1)[:n]


def _prefix(functions: np.ndarray) -> np.ndarray:
    """State after the first 1, 2, ... functions, from BEGIN, by doubling of compositions."""
    f, gap = functions, 1
    while gap < len(f):
        if np.all(f == f[:, :1]):
            break
        nxt = f.copy()
        nxt[gap:] = np.take_along_axis(f[gap:], f[:-gap].astype(np.intp), axis=1)
        f, gap = nxt, gap * 2
    return f[:, BEGIN]


def boundaries(classes: np.ndarray) -> np.ndarray:
    """Whether a piece begins at each position; a TEXT_START position begins none and ends what is before it."""
    if len(classes) == 0:
        return np.zeros(0, bool)
    state = scan_states(classes)
    before = np.empty_like(state)
    before[0], before[1:] = BEGIN, state[:-1]
    begins = STARTS[classes, before]
    after = np.empty_like(classes)
    after[:-1], after[-1] = classes[1:], TEXT_START
    later = np.empty_like(state)
    later[:-1], later[-1] = state[1:], BEGIN
    # letters after an apostrophe belong to it only if the contraction is completed
    begins &= ~((before == A) & ((state == DONE) | (((state == A_L) | (state == A_V) | (state == A_R)) & (later == DONE))))
    # the last white space of a run stands apart, or with what follows, if something follows
    white = (classes == SPACE) | (classes == WHITE)
    begins |= white & (after != SPACE) & (after != WHITE) & (after != TEXT_START)
    return begins & (classes != TEXT_START)


class BytePairEncoder:
    """ranks: bytes of each token -> id, lower ids merge first."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks, self.cache = ranks, {}
        self.bytes_of = None

    @classmethod
    def load(cls, path: str) -> BytePairEncoder:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())})

    def merge(self, piece: bytes) -> list[int]:
        ranks = self.ranks
        whole = ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        if n > 64:
            return self._merge_long(piece)
        parts = [piece[i : i + 1] for i in range(n)]
        while len(parts) > 1:
            best, at = sys.maxsize, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and r < best:
                    best, at = r, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same by a heap over a linked list: n log n."""
        n, ranks = len(piece), self.ranks
        end = list(range(1, n + 1))
        nxt, prev = list(range(1, n + 1)), list(range(-1, n - 1))
        alive = [True] * n
        heap = []

        def offer(i: int) -> None:
            j = nxt[i]
            if j < n:
                r = ranks.get(piece[i : end[j]])
                if r is not None:
                    heapq.heappush(heap, (r, i, end[i], end[j]))

        for i in range(n):
            offer(i)
        while heap:
            _, i, mid, last = heapq.heappop(heap)
            if not alive[i] or end[i] != mid:
                continue
            j = nxt[i]
            if j >= n or end[j] != last:
                continue
            alive[j] = False
            end[i], nxt[i] = last, nxt[j]
            if nxt[j] < n:
                prev[nxt[j]] = i
            offer(i)
            if prev[i] >= 0:
                offer(prev[i])
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = nxt[i]
        return out

    def piece_ids(self, piece: str) -> list[int]:
        ids = self.cache.get(piece)
        if ids is None:
            ids = self.merge(piece.encode())
            if len(piece) <= CACHE_LENGTH:
                if len(self.cache) >= CACHE_PIECES:
                    self.cache.clear()
                self.cache[piece] = ids
        return ids

    def encode_all(self, texts: list[str]) -> Iterator[list[int]]:
        """Ids of each text; the texts are scanned together."""
        if not any(texts):
            yield from ([] for _ in texts)
            return
        joined = "\0" + "\0".join(texts)
        classes = class_table()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        heads = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
        classes[heads] = TEXT_START
        at = np.flatnonzero(boundaries(classes))
        first = np.searchsorted(at, heads)
        first = [*first.tolist(), len(at)]
        at = at.tolist()
        get, miss = self.cache.get, self.piece_ids
        for k, (h, n) in enumerate(zip(heads.tolist(), lengths.tolist())):
            cuts = at[first[k] : first[k + 1]]
            out: list[int] = []
            for a, b in zip(cuts, [*cuts[1:], h + 1 + n]):
                p = joined[a:b]
                out += get(p) or miss(p)
            yield out

    def encode(self, text: str) -> list[int]:
        return next(self.encode_all([text]))

    def token_bytes(self) -> dict[int, bytes]:
        if self.bytes_of is None:
            self.bytes_of = {v: k for k, v in self.ranks.items()}
        return self.bytes_of

    def decode(self, ids: list[int]) -> str:
        table = self.token_bytes()
        return b"".join(table[i] for i in ids).decode("utf-8", "replace")

    def offsets(self, ids: list[int]) -> list[int]:
        """Byte offset in the UTF-8 text at which each token begins."""
        table, out, at = self.token_bytes(), [], 0
        for i in ids:
            out.append(at)
            at += len(table[i])
        return out


_ENCODERS: dict[str, BytePairEncoder] = {}


def encoder(path: str) -> BytePairEncoder:
    """One per Python worker and vocabulary."""
    if path not in _ENCODERS:
        _ENCODERS[path] = BytePairEncoder.load(path)
    return _ENCODERS[path]


def _groups(texts: list[str | None]) -> Iterator[list[str]]:
    group, size = [], 0
    for t in texts:
        t = t or ""
        if group and size + len(t) > SCAN_CHARS:
            yield group
            group, size = [], 0
        group.append(t)
        size += len(t)
    if group:
        yield group


def encode(docs: DataFrame, vocabulary: str = VOCABULARY, keep: str = "ids") -> DataFrame:
    """docs(doc_id, text) -> one row per row: (doc_id, ids), or with keep='offsets' (doc_id, ids, offsets), or with
    keep='count' (doc_id, tokens). No shuffle. Null and empty texts have no ids; white space is text; the strings of special
    tokens are ordinary text. Whole texts, whatever their length; other columns are ignored.
    """
    schema = {"ids": "ids array<int>", "offsets": "ids array<int>, offsets array<int>", "count": "tokens long"}[keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for b in batches:
            texts = b.column(1).to_pylist()
            start = 0
            for group in _groups(texts):
                ids = list(enc.encode_all(group))
                cols = [b.column(0).slice(start, len(group))]
                start += len(group)
                if keep == "count":
                    cols.append(pa.array([len(x) for x in ids], pa.int64()))
                else:
                    cols.append(pa.array(ids, pa.list_(pa.int32())))
                if keep == "offsets":
                    cols.append(pa.array([enc.offsets(x) for x in ids], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", *(c.split()[0] for c in schema.split(", "))])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"doc_id long, {schema}")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, ids) of every document."""
    return encode(read(spark, d, "documents"))


def p8_counts(spark: SparkSession, d: str) -> DataFrame:
    """Tokens per source and language."""
    docs = read(spark, d, "documents")
    return encode(docs, keep="count").join(docs.select("doc_id", "source", "lang"), "doc_id").groupBy("source", "lang").agg(F.count("*").alias("documents"), F.sum("tokens").alias("tokens"))


QUERIES = {"p8_ids": p8_ids, "p8_counts": p8_counts}
SQL: dict[str, str] = {}
