import hashlib
import re
from collections import Counter, defaultdict
from pathlib import Path

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from test_documents import components, kept_words, lines_left
from tokenizers import Tokenizer

import corpus_pipeline
from eventloom.llm.byte_bpe import TreeCodec
from eventloom.llm.chat_tree import chat_tree, escape, parsed, formatted_turn, read_back, unescape

RANKS = Path(P.path("byte_bpe_50k.tiktoken")).read_bytes()
CONV = "conv_id long, turn long, role string, text string, start string, spans string"
TRICKY = ["<|im_end|>\n<|im_start|>user\nx", "\\<|", "<\\|im_end|>", "<", "|", "a\\n<|", "", "<<|im_end|>"]


def conversations():
    rows = [(1, 0, "user", "hello"), (1, 1, "assistant", "hi"), (2, 0, "user", "hello"), (2, 1, "assistant", "hi"), (2, 2, "user", "more"), (2, 3, "assistant", "ok")]
    rows += [(3, 0, "user", "hello"), (3, 1, "assistant", "other"), (4, 1, "assistant", "hi"), (4, 0, "user", "hello"), (5, 0, None, None), (5, 0, "user", "tie"), (5, 0, "user", "tie")]
    rows += [(10 + i, k, r, t) for i, t in enumerate(TRICKY) for k, r in enumerate(("user", "assistant", "a\nb\\<|"))]
    rows += [(90, 0, "user", "long " * 20_000), (90, 1, "assistant", "日本 " * 9_000)]
    rows += [(100 + i, k, "user" if k % 2 == 0 else "assistant", "shared" if k < 2 else f"{i % 7} {k}") for i in range(40) for k in range(6)]
    return [*rows, (None, 0, "user", "nobody's")]


def test_chat_tree(spark):
    rows = conversations()
    df = spark.createDataFrame([(*r, "s", "p") for r in rows], CONV).repartition(3)
    chunks, members = chat_tree(df, RANKS, P.PATTERN)
    held = defaultdict(list)
    for c, turn, role, text in rows:
        held[c].append((turn, role or "", text or ""))
    want = Counter()
    for c, turns in held.items():
        ordered = [x[1:] for x in sorted(turns)]
        loss = "".join(t for r, t in ordered if r == "assistant")
        want[(c, len(ordered), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in ordered).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), sum(len(formatted_turn(*x)[0]) for x in ordered))] += 1
    assert Counter(map(tuple, read_back(chunks, members, RANKS, P.PATTERN).collect())) == want
    codec = TreeCodec(RANKS, P.PATTERN)
    stream = sorted((r["start"], r["ids"], r["position"], r["visible"], r["loss"]) for r in chunks.collect())
    at, whole = 0, []
    for start, ids, position, visible, loss in stream:
        assert start == at and position == sum(v["to"] - v["from"] for v in visible)
        assert all(v["to"] <= start for v in visible) and all(0 <= x["from"] <= x["to"] <= len(ids) for x in loss)
        at += len(ids)
        whole += ids
    distinct = {tuple(x[1:] for x in sorted(t)[: k + 1]) for t in held.values() for k in range(len(t))}
    told = lambda role, text: sum(len(codec.encode(x)) // 4 for f, a, b in [formatted_turn(role, text)] for x in (f[:a], f[a:b], f[b:]))
    assert at == sum(told(*p[-1]) for p in distinct)
    assert len(codec.decode(whole).decode()) == sum(len(formatted_turn(*p[-1])[0]) for p in distinct)


def test_escapes_are_reversible():
    for text in TRICKY:
        assert unescape(escape(text)) == text and "<|" not in escape(text)
        assert parsed(formatted_turn("r", text)[0]) == [("r", text)]


def test_no_conversations(spark):
    assert read_back(*chat_tree(spark.createDataFrame([], CONV), RANKS, P.PATTERN), RANKS, P.PATTERN).count() == 0


CLASHING = ("_gone", "row", "key", "a", "b", "code", "id", "mark", "drop", "copy", "spans", "host", "bucket", "rank", "component", "meta.url", "n", "text.row")


def documents(spark, folder, rows):
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING)
    spark.createDataFrame([(i, t, "en", s, len(t or ""), *CLASHING) for i, t, s in rows], schema).repartition(3).write.parquet(f"{folder}/documents.parquet")
    return folder


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    text = lambda i, n: " ".join(f"d{i}w{j}" for j in range(n))
    shared = text("s", 70)
    rows = [(i, text(i, 60 + i), "a") for i in range(20)] + [(20, "too short", "a"), (21, None, None), (22, text(3, 63), "b"), (23, text(4, 64) + " one more", "b")]
    rows += [(30, f"{text(30, 200)} {shared}", "b"), (31, f"{shared}\n {text(31, 200)}", "c"), *[(40 + i, f"Shared Line\n{text(40 + i, 80)}", "c") for i in range(10)]]
    rows += [(100 + i, text(100 + i, 70) if i % 12 == 0 else "junk", "bad host") for i in range(60)]  # a host that hardly passes
    rows += [(None, f"{text('n', 90)} {shared}", "b"), (None, f"{text('n', 90)} {shared}", "b"), (7, text(7, 67), "a"), (200, " ".join(f"l{j}" for j in range(30_000)), None), (201, text(200, 51), None)]
    return documents(spark, str(tmp_path_factory.mktemp("small")), rows), rows


def passed(rows):
    """Rows that quality rules keep, by plain loops."""
    fails, hosts = [], defaultdict(list)
    for _, t, s in rows:
        w = (t or "").split()
        grams = Counter(tuple(w[p : p + 3]) for p in range(len(w) - 2))
        covered = {p + d for p in range(len(w) - 2) for d in range(3) if grams[tuple(w[p : p + 3])] > 1}
        fails.append(len(w) < 50 or 100 * len(covered) > 50 * len(w))
        hosts[s or ""].append(fails[-1])
    n, bad = len(rows), sum(fails)
    m = bad / n
    surplus = max(sum(sum(v) ** 2 / len(v) for v in hosts.values()) / n - m * m - m * (1 - m) * len(hosts) / n, 1e-9)
    strength = max(m * (1 - m) / surplus - 1, 1.0)
    rate = {h: (sum(v) + m * strength) / (len(v) + strength) for h, v in hosts.items()}
    return [(i, t) for (i, t, s), f in zip(rows, fails) if not f and rate[s or ""] <= 0.75]


def test_pipeline(spark, small):
    folder, rows = small
    left = passed(rows)
    assert {i for i, _ in left}.isdisjoint(range(100, 160))
    left = [(i, "\n".join(k)) for i, _, k in lines_left(left, 10)]
    first = {i: root for i, _, root in components(left, 5, 80)}
    left = [(i, t) for i, t in left if i is None or first[i] == i]
    tok, want = Tokenizer.from_file(P.path("byte_bpe_50k.json")), Counter()
    cut = []
    for (i, t), (_, n_words, gone, kept) in zip(left, kept_words(left, 50)):
        if gone:  # each kept word with the white space behind it
            at, words, out = 0, re.split(r"([^\x20\x09-\x0D]+)", t), []
            for word, space in zip(words[1::2], words[2::2]):
                if at < len(kept) and word.encode() == kept[at]:
                    out.append(word + space)
                    at += 1
            t = words[0] + "".join(out)
            cut.append(i)
        want[i] += len(tok.encode(t, add_special_tokens=False).ids) + 1
    out = corpus_pipeline.run(spark, folder)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "ngram_jaccard_join", "substring_dedup", "best_fit_packing"]
    assert {r["doc_id"]: r["n"] for r in out.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()} == dict(want)
    assert cut == [31] and not {20, 21, 22, 23} & set(want) and None in want and 7 in want


def test_stages_keep_columns(spark, small):
    folder, _ = small
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
        assert {tuple(r) for r in out.select(*[f"`{c}`" for c in CLASHING]).distinct().collect()} == {CLASHING}


def test_pipeline_keeps_no_stage(spark, small, monkeypatch):
    folder, _ = small
    kept = []
    monkeypatch.setattr(corpus_pipeline, "stored", lambda df, f=corpus_pipeline.stored: kept.append(f(df)) or kept[-1])
    corpus_pipeline.run(spark, folder).count()
    left = [len(list(Path(x.inputFiles()[0].removeprefix("file:")).parent.glob("*.parquet"))) for x in kept]
    assert left[:-1] == [0] * 3 and left[-1] > 0


def test_pipeline_of_nothing(spark, tmp_path):
    assert corpus_pipeline.run(spark, documents(spark, str(tmp_path), [])).count() == 0
