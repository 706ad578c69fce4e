import base64
import random

import pytest

from loomgraph.llm import tokenize as tk

tiktoken = pytest.importorskip("tiktoken")
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(tk.VOCABULARY, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_same_ids_as_the_public_library(reference):
    rnd = random.Random(9)
    alphabet = "abslvredmt'' '  \n\t\r  　​1239.,!-éß中文🎉\x1c\x85²Ⅷ<|>"
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(0, 70))) for _ in range(4000)]
    texts += ["", " ", "\n\n", "don't we've 'll 'lx ''s x'S  'sabc", "<|endoftext|>", "a" * 3000 + " " * 500 + "ab" * 2000]
    enc = tk.encoder(tk.VOCABULARY)
    got = list(enc.encode_all(texts))
    assert got == [reference.encode_ordinary(t) for t in texts]
    assert [enc.decode(i) for i in got] == texts
    long = texts[-1]
    assert enc.offsets(enc.encode(long))[-1] < len(long.encode())


def test_scan_in_blocks_equals_one_scan():
    rnd = random.Random(1)
    classes = tk.np.array([rnd.randrange(12) for _ in range(1500)], tk.np.uint8)
    state, want = tk.BEGIN, []
    for c in classes:
        state = tk.TRANSITIONS[c, state]
        want.append(state)
    assert tk.scan_states(classes).tolist() == want


def test_frames(spark):
    docs = spark.createDataFrame([(1, "a b", 5), (2, None, 6), (3, "", 7), (1, "a b", 8), (None, "  ", 9)], "doc_id long, text string, ids long")
    rows = sorted(((r.doc_id or 0, list(r.ids)) for r in tk.encode(docs).collect()))
    enc = tk.encoder(tk.VOCABULARY)
    assert rows == [(0, enc.encode("  ")), (1, enc.encode("a b")), (1, enc.encode("a b")), (2, []), (3, [])]
    assert [list(r.offsets) for r in tk.encode(docs.limit(1), keep="offsets").collect()] == [[0, 1]]
    assert tk.encode(docs.limit(0), keep="count").count() == 0
