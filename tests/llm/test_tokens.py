import base64
import hashlib
import random
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from eventloom.llm import byte_bpe
from eventloom.llm.byte_bpe import ByteRanks, TreeCodec, decoded, encoded, round_trip
from eventloom.llm.packing import UnitEncoder, best_fit_plan, bucketed, packed
from eventloom.llm.token_counts import token_counts

RANKS = Path(P.path("byte_bpe_50k.tiktoken")).read_bytes()
WORDS, BYTES = (Path(P.path(n)).read_bytes() for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, RANKS.splitlines())}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_round_trip_equals_library(docs, rows, library):
    got = Counter(map(tuple, round_trip(docs, RANKS, P.PATTERN).collect()))
    want = Counter()
    for key, text in rows:
        ids = np.array(library.encode_ordinary(text or ""), "<u4").tobytes()
        want[(key, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())] += 1
    assert got == want


def test_encode_then_decode(docs, rows):
    back = decoded(encoded(docs, RANKS, P.PATTERN), RANKS, P.PATTERN).collect()
    assert Counter((r["doc_id"], bytes(r["data"])) for r in back) == Counter((k, (t or "").encode()) for k, t in rows)


def test_tree_joins_are_exact(library):
    codec, rng = TreeCodec(RANKS, P.PATTERN), random.Random(7)
    for alphabet in ("ab", "a ", "  x\n", "abcdefghij", "'s ltvre", "ab1! ", "\x1c a\x1f", "é ü z", "\n"):
        for n in (0, 1, 50, 3000, 9000):
            text = "".join(rng.choice(alphabet) for _ in range(n))
            assert np.frombuffer(codec.encode(text), "<u4").tolist() == library.encode_ordinary(text)
    ranks = ByteRanks(RANKS)
    for n in (1, 23, 24, 25, 200, 1000):
        data = bytes(rng.choice(b"abcz") for _ in range(n))
        assert ranks.match(data) == ranks.merged(data)


def test_ordinary_documents_are_joined(rows, monkeypatch):
    codec, seams, grown = TreeCodec(RANKS, P.PATTERN), [0], [0]
    joined = ByteRanks.joined

    def counted(self, left, right):
        seams[0] += 1
        before = grown[0]
        out = joined(self, left, right)
        if len(left) > 1 and out[: len(left) - 1] != left[:-1]:
            grown[0] = before + 1  # the window took in more than the tokens at the seam
        return out

    monkeypatch.setattr(ByteRanks, "joined", counted)
    for _, text in rows:
        codec.encode(text or "")
    assert seams[0] > 1000 and grown[0] > 0
    assert "tiktoken" not in vars(byte_bpe) and "tiktoken" not in Path(byte_bpe.__file__).read_text()


def test_counts_equal_library(docs, rows):
    tok = Tokenizer.from_str(WORDS.decode())
    got = Counter(map(tuple, token_counts(docs, WORDS, 100).collect()))
    want = Counter()
    for key, text in rows:
        n = len(tok.encode(text or "", add_special_tokens=False).ids)
        want[(key, len((text or "").encode()), n, n > 100)] += 1
    assert got == want


def test_plan_is_best_fit_decreasing():
    rng = random.Random(1)
    for _ in range(300):
        capacity = rng.choice([1, 2, 7, 20, 100])
        sizes = [rng.randint(1, capacity) for _ in range(rng.randint(0, 60))]
        open_bins: list[int] = []
        for s in sorted(sizes, reverse=True):
            fit = [r for r in open_bins if r >= s]
            left = min(fit) if fit else capacity
            if fit:
                open_bins.remove(left)
            open_bins.append(left - s)
        bins: dict[int, list] = {}
        plan = best_fit_plan(Counter(sizes), capacity)
        for s, n in Counter(sizes).items():
            own = [r for r in plan.tolist() if r[0] == s]
            for q in range(n):
                r = [x for x in own if x[1] <= q][-1]
                bins.setdefault(r[2] + (q - r[1]) // r[3], []).append((r[4] + (q - r[1]) % r[3] * s, s))
        assert len(bins) == len(open_bins) and set(bins) == set(range(len(bins)))
        for content in bins.values():
            at = 0
            for offset, s in sorted(content):
                assert offset == at
                at += s
            assert at <= capacity


def test_packing(docs, rows):
    tok = Tokenizer.from_str(BYTES.decode())
    ids = [(k, np.array(tok.encode(t or "", add_special_tokens=False).ids + [0], "<u4")) for k, t in rows]
    out = packed(docs, BYTES, P.PATTERN, 256).collect()
    by_crc = Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out)
    want = Counter()
    for key, x in ids:
        cuts = [0, *range(len(x) % 256 or 256, len(x), 256), len(x)]
        for p, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[(key, p, a, b - a, zlib.crc32(x[a:b].tobytes()))] += 1
    assert by_crc == want
    bins: dict[int, list] = {}
    for r in out:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for content in bins.values():
        at = 0
        for offset, n in sorted(content):
            assert offset == at
            at += n
        assert at <= 256
    assert len(bins) <= 1.02 * -(-sum(len(x) for _, x in ids) // 256) + 1


def test_units_equal_tokenizers():
    tok, encoder, rng = Tokenizer.from_str(BYTES.decode()), UnitEncoder(BYTES, P.PATTERN), random.Random(3)
    for alphabet in ("ab. ", "a,b!? \n", "é1'.s t", "<|endoftext|> x.", "日本. ,", "Zz;:a ", "\x1c .a\x85"):
        for n in (1, 2, 7, 60, 500):
            for _ in range(8):
                text = "".join(rng.choice(alphabet) for _ in range(n))
                assert np.frombuffer(encoder.encode(text), "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids, repr(text)


def test_empty_tables(no_docs):
    assert round_trip(no_docs, RANKS, P.PATTERN).count() == 0
    assert token_counts(no_docs, WORDS, 10).count() == 0
    assert packed(no_docs, BYTES, P.PATTERN, 256).count() == 0


def test_pieces_without_an_id_are_spread(spark):
    pieces = spark.createDataFrame([(None, 0, 0, 5, 77)] * 10_000 + [(i, 0, 0, 5, 77) for i in range(100)], "id long, piece int, start long, length long, ids_crc32 long").repartition(3)
    sizes = [r["count"] for r in bucketed(pieces.filter("id IS NULL"), 16).groupBy("bucket").count().collect()]
    assert len(sizes) == 16 and max(sizes) < 1000
    assert bucketed(pieces, 16).columns == [*pieces.columns, "bucket"]
