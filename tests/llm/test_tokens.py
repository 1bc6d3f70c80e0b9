"""BPE, token files, chat formatting and the pipeline."""

import hashlib
import json
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from ruleloom.llm import bpe, chat, wavelet  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.json")
PIECES = ["a", "b", " ", "  ", "\n", "\t", "'", "'s", "'ll", "''", "!", "!'", "é", "É", " ", "　", " ", "\u0085", "\x1c", "\x1f", "ß", "中", "文", "😀", "‍", "1", "23", "<|endoftext|>", "<|", "|>", ".", "don't", "\r\n", "\x00", "_", "--", "Ω", "᠎"]


def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.no_padding()
    t.no_truncation()
    return t


def odd_texts(n, seed=0):
    r = random.Random(seed)
    out = ["".join(r.choice(PIECES) for _ in range(r.randint(0, 14))) for _ in range(n)]
    return out + ["".join(chr(r.choice([r.randint(0, 0x2FFF), r.randint(0, 255), r.randint(0x10000, 0x1FFFF)])) for _ in range(r.randint(0, 30))) for _ in range(n // 4)]


def rows_of(texts):
    return [(k, t, "en", k) for k, t in enumerate(texts)]


def test_encoding_is_that_of_the_library(spark):
    texts = [*odd_texts(1500), None, "", "word " * 100_000, "x" * 50_000, "same", "same"]
    docs = spark.createDataFrame(rows_of(texts), "doc_id long, text string, ids string, n_tokens long")
    t = library()
    out = bpe.decode(bpe.encode(docs, ["doc_id"], PATH), PATH)
    for r in out.collect():
        want = t.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert np.frombuffer(r.ids, "<u4").tolist() == want and r.n_tokens == len(want)
        assert r.text == t.decode(want, skip_special_tokens=False) == (texts[r.doc_id] or "")
    d = {r.doc_id: r for r in bpe.digests(docs.limit(50), ["doc_id"], PATH).collect()}
    assert all(r.decoded_sha256 == hashlib.sha256((texts[k] or "").encode()).hexdigest() for k, r in d.items())
    assert bpe.digests(docs.limit(0), ["doc_id"], PATH).count() == 0


def test_forgetting_changes_nothing(monkeypatch):
    texts, t = [x.encode() for x in odd_texts(400, 3)], library()
    monkeypatch.setattr(bpe, "FRAGMENTS_KEPT", 50)
    b = bpe.ForcedBpe(PATH)
    for k in range(0, len(texts), 40):
        ids, n = b.encode(texts[k : k + 40])
        assert ids.tolist() == [i for x in texts[k : k + 40] for i in t.encode(x.decode(), add_special_tokens=False).ids]


def test_decoding_row_by_row(spark):
    """Rows whose ids end inside a character that the next row's ids complete, unknown ids, null."""
    t = library()
    b = bpe.ForcedBpe.load(PATH)
    part = {bytes(b.bytes[a : a + n]): k for k, (a, n) in enumerate(zip(b.start.tolist(), b.length.tolist())) if n == 1}
    ids = [part[bytes([x])] for x in "é中".encode()]
    rows = [(0, ids[:1]), (1, ids[1:3]), (2, ids[3:]), (3, [*ids, 10_000_000, 4_000_000_000]), (4, []), (5, None), (6, ids[:2])]
    df = spark.createDataFrame([(k, None if x is None else bytearray(np.array(x, "<u4").tobytes())) for k, x in rows], "k int, ids binary").coalesce(1)
    got = {r.k: r.text for r in bpe.decode(df, PATH).collect()}
    assert got == {k: None if x is None else t.decode([i for i in x if i < 10**6], skip_special_tokens=False) for k, x in rows}


def test_registered_queries_against_the_library(spark, tmp_path):
    texts = [*odd_texts(120, 7), None, "", "word " * 3000]
    spark.createDataFrame([(k * 3 % 200, t, "x", 1) for k, t in enumerate(texts)], "doc_id long, text string, ids string, n_tokens int").write.parquet(str(tmp_path / "documents.parquet"))
    t, start = library(), 0
    five = {r.doc_id: r for r in bpe.op5_bpe(spark, str(tmp_path)).collect()}
    nine = {r.doc_id: r for r in wavelet.op9_token_file(spark, str(tmp_path)).collect()}
    assert len(five) == len(nine) == len(texts)
    for k, x in sorted((k * 3 % 200, x) for k, x in enumerate(texts)):
        ids = t.encode(x or "", add_special_tokens=False).ids
        said = hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()
        assert (five[k].n_tokens, five[k].ids_sha256, five[k].decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), said)
        ids.append(2)
        assert (nine[k].start, nine[k].n_tokens, nine[k].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


@pytest.mark.parametrize("n, v", [(0, 1), (1, 1), (63, 2), (64, 3), (65, 50257), (3000, 7), (3000, 70_000)])
def test_wavelet_matrix(n, v):
    ids = np.random.default_rng(n + v).integers(0, v, n).astype(np.uint32)
    s = wavelet.Shard(wavelet.pack(ids, np.array([5, -(1 << 63)]), np.array([n // 2, n - n // 2])))
    assert (s.tokens() == ids).all() and s.lengths.tolist() == [n // 2, n - n // 2] and s.doc_ids[1] == wavelet.NO_ID
    if n:
        assert (s.access(np.arange(n)) == ids).all()
    for t in {*ids[:5].tolist(), 3}:
        assert s.count(t) == (ids == t).sum() and s.count(t, n // 3) == (ids[: n // 3] == t).sum()
        assert (s.occurrences(t) == np.flatnonzero(ids == t)).all()


def test_token_files(spark, tmp_path):
    texts = [*odd_texts(200, 5), None, "", "word " * 20_000]
    rows = [(k * 7 % len(texts), t, 1) for k, t in enumerate(texts)] + [(3, "again", 1), (3, "again", 1), (None, "no id", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard int")
    where = str(tmp_path / "tokens")
    wavelet.write_shards(docs, "doc_id", PATH, 2, where, 3, shard_tokens=5_000)
    got = sorted(map(tuple, wavelet.read_shards(spark, where).collect()), key=lambda r: r[1])
    t, start = library(), 0
    order = [-1 if r[0] is None else r[0] for r in got]
    assert order == sorted(order) and len(got) == len(rows)
    left = {}
    for k, x, _ in rows:
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 2]
        left.setdefault(k, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    for k, at, n, crc in got:
        assert at == start
        left[k].remove((n, crc))
        start += n
    ids = [i for k, x, _ in rows for i in [*t.encode(x or "", add_special_tokens=False).ids, 2]]
    counts = {r.token: r.n for r in wavelet.count_tokens(spark, where, [2, 220, 64]).collect()}
    assert counts == {k: ids.count(k) for k in (2, 220, 64)}
    assert wavelet.find_token(spark, where, 2).count() == ids.count(2)
    empty = str(tmp_path / "none")
    wavelet.write_shards(docs.limit(0), "doc_id", PATH, 2, empty, 2)
    assert wavelet.read_shards(spark, empty).count() == 0


# chat


def brute_chats(rows):
    convs: dict = {}
    for c, t, r, x in sorted(rows, key=lambda q: (q[0] is not None, q[0] or 0, q[1] is not None, q[1] or 0, q[2] or "", q[3] or "")):
        convs.setdefault(c, []).append((r or "", x or ""))
    return convs


@pytest.mark.parametrize("options", [{}, {"budget": 40, "history_turns": 3, "history_tokens": 16}, {"budget": 8, "history_turns": 0, "history_tokens": 0}, {"budget": 40, "history_turns": 3, "history_tokens": 16, "row_bytes": 300}, {"budget": 30, "history_turns": 0, "row_bytes": 0}])
def test_chats_read_back(spark, options):
    r = random.Random(1)
    parts = ["hello", "<turn user>", "</turn>", "\\", "\\\\", "\\l", "\n", "é😀", "### Assistant:", ">", " ", "</turn>\n"]
    rows = [(c, t, r.choice(["user", "assistant", "system", "to>ol\\"]) if t else "system", "".join(r.choice(parts) for _ in range(r.randint(0, 12)))) for c in range(25) for t in range(r.randint(1, 9))]
    rows += [(100, 0, None, None), (100, 1, "assistant", None), (101, 0, "assistant", "x"), (101, 0, "assistant", "x"), (101, 0, "user", "x"), (None, None, "user", "nobody"), (102, 0, "assistant", "word " * 20_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("window", F.lit(1)).withColumn("tokens", F.lit("x"))
    windows = chat.format_chats(df, **options)
    read = chat.read_chats(windows).collect()
    told = {}
    for x in sorted(read, key=lambda x: x.window):
        told.setdefault(x.conv_id, ([], []))
        told[x.conv_id][0].extend((t.role, t.text) for t in x.turns)
        told[x.conv_id][1].extend(x.targets)
    want = brute_chats(rows)
    assert {k: v[0] for k, v in told.items()} == want
    assert {k: v[1] for k, v in told.items()} == {k: [x for role, x in v if role == "assistant"] for k, v in want.items()}
    budget = options.get("budget", 512)
    for w in windows.collect():
        turns = w.formatted.count("</turn>\n") - w.n_repeated
        assert w.n_tokens <= budget or turns == 1
        if w.window and want[w.conv_id][0][0] == "system":
            assert w.formatted.startswith("<turn system>") and w.n_repeated >= 1
    assert chat.format_chats(df.limit(0)).count() == 0


def test_both_ways_to_windows_agree(spark):
    r = random.Random(4)
    rows = [(c or None, t, "system" if t == 0 and c % 3 else r.choice(["user", "assistant"]), "w " * r.randint(0, 30)) for c in range(12) for t in range(r.randint(1, 40))]
    rows.append((3, 50, "assistant", "x" * 10_000))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for options in ({"budget": 60, "history_tokens": 20}, {"budget": 60, "history_turns": 0, "history_tokens": 0}, {"budget": 100, "history_turns": 9, "history_tokens": 60}):
        ways = [sorted(map(repr, chat.format_chats(df, row_bytes=n, **options).select("conv_id", "window", "formatted", "n_repeated", "loss", "n_tokens").collect())) for n in (1 << 20, 3_000, 0)]
        assert ways[0] == ways[1] == ways[2] and len(ways[0]) > 50


def test_window_starts_in_several_runs(spark):
    n = 2 * chat.RUN + 10
    df = spark.createDataFrame([(1, k, "user", "a b c") for k in range(n)], "conv_id long, turn long, role string, text string")
    assert chat.format_chats(df, 8, 0, 0).count() == n


def test_tokens_counted_by_the_caller(spark):
    rows = [(1, k, "system" if k == 0 else "user", f"t{k}", n) for k, n in enumerate([10, 100, 100, 100, None, 300])]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, mine int")
    got = {r.window: (r.n_tokens, r.n_repeated, r.formatted.count("</turn>")) for r in chat.format_chats(df, 300, 1, 50, "mine").collect()}
    # room of a window: 300 - 50 - 14; turns cost 14, 104, 104, 104, 4, 304
    assert got == {0: (222, 0, 3), 1: (14 + 104 + 4, 1, 3), 2: (14 + 4 + 304, 2, 3)}


def test_chat_query_is_native(spark, tmp_path):
    spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "yes")], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    out = {r.conv_id: r for r in chat.op8_chat_format(spark, str(tmp_path)).collect()}
    said = "\\### Assistant: </turn> ok"
    assert out[-7].turns_sha256 == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
    assert out[-7].loss_sha256 == hashlib.sha256(said.encode()).hexdigest() and out[-7].loss_chars == len(said) and out[1].n_turns == 2
    plan = chat.format_chats(spark.read.parquet(str(tmp_path / "conversations.parquet")))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_pipeline_against_brute_force(spark, tmp_path):
    """run() on a small corpus: what goes, what stays and what the last stage returns."""
    import corpus_pipeline

    r = random.Random(9)
    words = {"en": "the thing and other with from that this".split(), "de": "der die und nicht schon über auch eine".split()}
    text = lambda lang, n: " ".join(r.choice(words[lang]) + r.choice(["", "s", "er", "en"]) for _ in range(n))
    rows = [(k, text(lang, 80), lang) for k, lang in enumerate(["en", "de"] * 30)]
    shared = text("en", 12)
    rows += [(60 + k, f"{text('en', 40)}\n{shared}\n{text('en', 40)}", "en") for k in range(6)]
    item = text("en", 14)
    rows += [(70, rows[0][1], "en"), (71, rows[0][1] + " more", "en"), (72, "1234 !!", "en"), (73, None, "en"), (74, "", None), (75, f"{text('en', 20)} {item.upper()} {text('en', 20)}", "en"), (76, text("de", 120), "en")]
    docs = spark.createDataFrame([(k, t, g, "s", len(t or "")) for k, t, g in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item), (2, "zzz zzz zzz")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {x.doc_id: x for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    final = {k: t for k, t, _ in rows if k not in (70, 71, 72, 73, 74, 75, 76)}
    for k in range(60, 65):
        final[k] = "\n".join(x for x in final[k].split("\n") if x != shared)
    assert set(got) == set(final)
    t = library()
    for k, x in got.items():
        ids = t.encode(final[k], add_special_tokens=False).ids
        assert x.n_tokens == len(ids) and x.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() and x.decoded_sha256 == hashlib.sha256(final[k].encode()).hexdigest()
    stage = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, f in corpus_pipeline.STAGES[:-1]:
        out = f(spark, stage.union(stage.limit(3)), str(tmp_path))
        assert out.columns == stage.columns
        assert f(spark, stage.limit(0), str(tmp_path)).count() == 0
    assert json.dumps([n for n, _ in corpus_pipeline.STAGES])


def test_pipeline_with_any_columns(spark, tmp_path):
    """Columns that are named like anything the operators use pass through every stage unchanged."""
    import corpus_pipeline

    words = "the thing and other with from that this".split()
    r = random.Random(2)
    rows = [(k, " ".join(r.choice(words) for _ in range(30)), "en", "s", 0) for k in range(12)]
    names = ["id", "mask", "text_", "letters", "score", "lang_pred", "items", "hits", "n_words", "row", "row_", "rest", "key", "n_lines", "n_dropped", "_text", "_id", "_letters", "_some", "component_id", "kept", "n_shingles", "_row", "a.b", "held_out", "digest_"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").select("*", *(F.concat(F.lit(f"{n}:"), F.col("doc_id").cast("string")).alias(n) for n in names))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "zzz zzz zzz")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    stage = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, f in corpus_pipeline.STAGES[:-1]:
        out = f(spark, stage, str(tmp_path))
        assert out.columns == docs.columns and out.schema["score"].dataType.typeName() == "string"
        got = out.collect()
        assert len(got) == 12 and all(x[n] == f"{n}:{x.doc_id}" for x in got for n in names)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 12


def test_pipeline_drops_rows_by_their_own_text(spark):
    """Repeated and null ids: what is no copy stays, what is a copy goes, whatever else has the same id."""
    import corpus_pipeline

    a, b, c, d = (" ".join(f"{x}{k}" for k in range(30)) for x in "abcd")
    rows = [(1, a), (2, a), (2, b), (3, c), (3, d), (3, c), (None, a), (None, "x " + " ".join(f"n{k}" for k in range(30))), (4, ""), (4, ""), (4, None), (5, ""), (None, "")]
    rows += [(None, rows[7][1])]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    want = sorted([(1, a), (2, b), (3, c), (3, d), (None, rows[7][1]), (4, ""), (4, None), (5, ""), (None, "")], key=str)
    for x in (docs, docs.repartition(5)):
        out = corpus_pipeline.near_duplicates(spark, x, "")
        assert out.columns == docs.columns and sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == want
