"""Each operator against brute force on rows with nulls, ties, copies, long and empty texts, and on an empty table."""

import hashlib
import itertools
import json
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from strophe.llm import attribution, chat, decontaminate, graph, language, mixing, quality, sharding, simhash, substrings, tokens

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


# 1


def test_token_index(docs, rows, nothing):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    got = [tuple(r) for r in tokens.token_index(docs, path).orderBy(F.col("doc_id").asc_nulls_first(), "start").collect()]
    whole, at, want = Tokenizer.from_file(path), 0, []
    for doc_id, text in sorted(((r[0], r[1]) for r in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, (x[1] or "").encode())):
        ids = np.array([*whole.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        want.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == want
    assert tokens.token_index(nothing, path).count() == 0


def test_encoder_equals_the_tokenizer():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    rng = random.Random(1)
    parts = ["a", "B", "é", "É", "ß", "'s", "'", "’", "1", "½", "²", "ª", "µ", "́", "\xa0", "\x1c", "\x85", "<|endoftext|>", "<|", "İ", "Σ", " ", "\n", "日本", "😀", "I'LL", "×", "ÿ", "_", "'re'"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 20))) for _ in range(2000)]
    own = tokens.Encoder(path)
    for text, x in zip(texts, Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(own.encode(text), dtype="<u4").tolist() == x.ids, text


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_any_tokenizer_gives_its_own_ids(name, tmp_path):
    from tokenizers import Tokenizer, normalizers

    rng = random.Random(2)
    parts = ["The", " the ", "ß", "Ünï", "’s", "'LL", "1", "23", "½", "\n\n", "日本", "\x00", "<|endoftext|>", "a\u0301"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 15))) for _ in range(400)]
    whole = Tokenizer.from_file(public_tokenizers.path(name))
    changed = Tokenizer.from_file(public_tokenizers.path(name))
    changed.normalizer = normalizers.NFKC()  # no lower case
    changed.save(str(tmp_path / "changed.json"))
    for path, want in ((public_tokenizers.path(name), whole), (str(tmp_path / "changed.json"), changed)):
        own = tokens.Encoder(path)
        assert own.cuts == (name == "word_bpe_49k.json" and want is whole)
        for t in texts:
            assert np.frombuffer(own.encode(t), dtype="<u4").tolist() == want.encode(t, add_special_tokens=False).ids


def test_one_id_spans_many_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tokens, "FILE_BYTES", 2000)
    same = spark.range(3000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("one text").alias("text"))
    other = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("x"), F.col("id")).alias("text"))
    path = f"file://{tmp_path}/tok"
    tokens.write_tokens(same.unionAll(other), public_tokenizers.path("word_bpe_49k.json"), path)
    files = tokens.read_tokens(spark, path).groupBy(F.input_file_name().alias("f")).count().collect()
    assert len(files) > 15 and max(r["count"] for r in files) < 1500


def test_files_carry_indexes(spark, docs, tmp_path, monkeypatch):
    """Run lengths, row groups and Bloom filters as the files' own metadata has them, and a filter that prunes."""
    path = f"file://{tmp_path}/tok"
    many = spark.range(12_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("some words "), F.col("id")).alias("text"))
    tokens.write_tokens(many, public_tokenizers.path("word_bpe_49k.json"), path)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    spans, rows = [], 0
    for f in sorted(p for p in tmp_path.rglob("part-*.orc")):
        reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(str(f)), jvm.org.apache.orc.OrcFile.readerOptions(conf))
        assert reader.getRowIndexStride() == 1000 and reader.getStripes().size() >= 1
        footer = reader.rows().readStripeFooter(reader.getStripes().get(0))
        kinds = [s.getKind().toString() for s in footer.getStreamsList()]
        assert "ROW_INDEX" in kinds and "BLOOM_FILTER_UTF8" in kinds
        encodings = [c.getKind().toString() for c in footer.getColumnsList()]
        assert encodings.count("DIRECT_V2") >= 3  # integers and list lengths run-length encoded
        told = reader.getStatistics()[1]
        spans.append((told.getMinimum(), told.getMaximum()))
        rows += reader.getNumberOfRows()
    assert rows == 12_000 and len(spans) >= 4 and all(a[1] < b[0] for a, b in zip(sorted(spans), sorted(spans)[1:]))
    found = tokens.lookup(spark, path, [3, 11_005])
    assert {r["doc_id"] for r in found.collect()} == {3, 11_005}
    assert "PushedFilters: [In(doc_id" in found._jdf.queryExecution().toString().replace("PushedFilters: [IsNotNull(doc_id), In", "PushedFilters: [In")


# 2


def test_chat_round_trip(spark):
    rows = [(1, 1, "assistant", "</s>[INST] ok"), (1, 0, "user", "a\\l<b>[c]\\\\"), (1, 0, "user", "a\\l<b>[c]\\\\"), (2, None, None, None), (None, 0, "assistant", "x\\"), (3, 0, "sys<tem", "\\b"), (4, 0, "user", "y" * 100_000)]
    out = chat.formatted(chat.turn_rows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("conv_id", F.col("conv_id")))).cache()
    got = {r["conv_id"]: r for r in out.select("*", chat.parsed(F.col("formatted")).alias("turns")).collect()}
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t is not None, t or 0, r or "", x or ""))
    for c, turns in by.items():
        assert [(t["role"], t["text"]) for t in got[c]["turns"]] == [x[2:] for x in sorted(turns)]
        assert got[c]["formatted"].count("</s>") == got[c]["formatted"].count("[INST]") == len(turns)
        masked = [got[c]["formatted"][m["start"] : m["stop"]] for m in got[c]["loss_mask"]]
        assert len(masked) == sum(x[2] == "assistant" for x in turns)
    told = chat.digests(out).filter("conv_id = 1").first()
    assert told["loss_sha256"] == hashlib.sha256(b"</s>[INST] ok").hexdigest() and told["loss_chars"] == 13
    assert chat.formatted(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_layouts(spark):
    records = [
        ('{"messages": [{"role": "user", "content": "hi"}]}', "messages", [("user", "hi")]),
        ('{"id": 7, "meta": {"a b": [1], "c,d": {"e": null}}, "messages": [{"content": "hi", "role": "user", "n": 1}, {"role": null, "content": null}]}', "messages", [("user", "hi"), (None, None)]),
        ('{"messages": [{"role": "user", "content": [{"type": "text", "text": "a"}, {"type": "text", "text": "b"}]}]}', "message_parts", [("user", "ab")]),
        ('{"messages": []}', "no_messages", []),
        ('{"prompt": "p", "completion": "c", "source": "x"}', "prompt_completion", [("user", "p"), ("assistant", "c")]),
        ('{"question": "q", "answer": null}', "question_answer", [("user", "q"), ("assistant", None)]),
        ('{"instruction": "i", "input": "n", "output": "o"}', "instruction", [("user", "i\n\nn"), ("assistant", "o")]),
        ('{"output": "o", "instruction": "i"}', "instruction_only", [("user", "i"), ("assistant", "o")]),
        ('{"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}', "from_value", [("user", "q"), ("assistant", "a")]),
        ('{"other": 1}', None, None), ('{"prompt": "p", "messages": [{"role": "user", "content": "x"}]}', None, None), ("not json", None, None), ("[1, 2]", None, None), ("{}", None, None), (None, None, None), ("not json", None, None),
    ]
    mapped = chat.json_turns(spark.createDataFrame([(i, r) for i, (r, _, _) in enumerate(records)], "conv_id long, record string")).cache()
    got = mapped.orderBy("conv_id").collect()
    assert [r["layout"] for r in got] == [x for _, x, _ in records]
    assert [r["turns"] and [tuple(t) for t in r["turns"]] for r in got] == [x for _, _, x in records]
    assert chat.rejected(mapped).count() == 7 and {str(r["paths"]): r["n"] for r in chat.reject_counts(mapped).collect()}["None"] == 3
    typed = spark.createDataFrame([(1, [("user", "hi")], "x")], "conv_id long, messages array<struct<role string, content string>>, source string")
    assert [tuple(r) for r in chat.turn_rows(typed).collect()] == [(1, 0, "user", "hi")]
    with pytest.raises(ValueError):
        chat.turn_rows(spark.createDataFrame([(1, 2)], "conv_id long, strange int"))


def test_json_paths_at_any_depth(spark):
    def plain(v, at=""):
        if isinstance(v, dict):
            return {p for k, x in v.items() for p in plain(x, f"{at}.{k}" if at else k)}
        return {p for x in v for p in plain(x, f"{at}[]")} or {f"{at}[]"} if isinstance(v, list) else {at}

    rng = random.Random(4)

    def record(depth):
        kind = rng.random()
        if depth and kind < 0.5:
            return {rng.choice(["a", "OBJECT", "b c", "d,e", "f:g", "<h>", "i`j", "1", "ARRAY"]): record(depth - 1) for _ in range(rng.randint(1, 3))}
        if depth and kind < 0.7:
            inner = record(depth - 1)
            return [inner, inner]
        return rng.choice([1, 2.5, "x", True, None, "2020-01-01", 10**25])

    records = [{"k": record(5)} for _ in range(300)]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)], "i int, record string")
    got = {r["i"]: set(r["p"]) for r in df.select("i", chat.json_paths(F.col("record")).alias("p")).collect()}
    assert got == {i: plain(r) for i, r in enumerate(records)}


def test_turn_ties_sort_by_text(spark):
    rows = [(1, 0, "user", "["), (1, 0, "user", "<"), (1, 0, "user", "\\"), (1, 0, "user", "a")]
    out = chat.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).select(chat.parsed(F.col("formatted")).alias("t")).first()
    assert [t["text"] for t in out["t"]] == ["<", "[", "\\", "a"]


# 3


def test_shards(docs, rows, nothing):
    got = sharding.shard_rows(docs, 8).collect()
    assert len(got) == len(rows)
    sizes, slots = Counter(), defaultdict(list)
    for r in got:
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert set(sizes) <= set(range(8)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    want = Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    assert sharding.shard_rows(nothing, 8).count() == 0


def test_shards_are_even_with_ties(spark):
    flat = spark.range(4000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("same text").alias("text"), F.lit("en").alias("lang"), F.lit("a").alias("source"))
    sizes = sharding.shard_rows(flat, 8).groupBy("shard").agg(F.sum("size").alias("s")).collect()
    assert len(sizes) == 8 and max(r["s"] for r in sizes) - min(r["s"] for r in sizes) <= 20


def shard_set(df):
    return Counter(map(tuple, df.collect()))


def test_shards_do_not_depend_on_file_splits(spark, docs):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    once = shard_set(sharding.shard_rows(d))
    assert shard_set(sharding.shard_rows(d.repartition(5))) == shard_set(sharding.shard_rows(d.orderBy(F.desc("text")).repartition(3, "lang"))) == once
    assert shard_set(sharding.shard_rows(docs)) == shard_set(sharding.shard_rows(docs.repartition(7)))


def test_shards_follow_the_tree(spark):
    """Nodes split by hand: the widest dimension, rows in the order of its coordinate, half the bytes to the left."""
    rows = [(i, "x" * (10 + i * 7 % 50), f"source_{i % 23}", "ab"[i % 2]) for i in range(400)]
    got = {r["doc_id"]: r["shard"] for r in sharding.shard_rows(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string"), 4).collect()}
    at = {k: sorted({r[k] for r in rows}) for k in (2, 3)}
    spot = {r[0]: (r[0], len(r[1]) + 1, at[2].index(r[2]), at[3].index(r[3])) for r in rows}
    whole = [max(x) - min(x) for x in zip(*spot.values())]

    def split(ids, k, first):
        if k == 1:
            assert {got[i] for i in ids} == {first}
            return
        spans = [(max(x) - min(x)) / w for x, w in zip(zip(*(spot[i] for i in ids)), whole)]
        d = spans.index(max(spans))
        left = [i for i in ids if got[i] < first + k // 2]
        right = [i for i in ids if got[i] >= first + k // 2]
        assert max(spot[i][d] for i in left) <= min(spot[i][d] for i in right)
        size = lambda x: sum(spot[i][1] for i in x)
        assert abs(size(left) - size(ids) * (k // 2) / k) <= max(spot[i][1] for i in ids)
        split(left, k // 2, first)
        split(right, k - k // 2, first + k // 2)

    split(list(spot), 4, 0)


def test_shards_of_target_bytes(spark):
    d = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit("y" * 99).alias("text"), F.lit("en").alias("lang"), F.lit("a").alias("source"))
    sizes = sharding.shards_of_bytes(d, 9_500).groupBy("shard").agg(F.sum("size").alias("s")).collect()
    assert len(sizes) == 11 and max(r["s"] for r in sizes) <= 9_500 and sharding.leaves_for(d.limit(0), 10) == 1


# 4


def base_counts(text):
    ws = words(text)
    wins = [tuple(ws[i : i + 8]) for i in range(len(ws) - 7)]
    twice = Counter(wins)
    covered = {i + k for i, w in enumerate(wins) if twice[w] > 1 for k in range(8)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(docs, rows, nothing):
    got = quality.quality_rows(docs)
    fields = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert Counter((r["doc_id"], *(r[f] for f in fields)) for r in got.collect()) == Counter((r[0], *base_counts(r[1])) for r in rows)
    for r in got.collect():
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]) and not (r["kept"] and r["base_failed"])
    assert quality.quality_rows(nothing).count() == 0
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == got.filter("kept").count()


def test_quality_sketches_merge(docs):
    from strophe.llm.common import materialise

    counted = materialise(quality.with_counts(docs), "t")
    half = [quality.sketches(counted.filter(F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(2)) == k)) for k in (0, 1)]
    once = quality.sketches(counted)
    cols = once.columns
    both = half[0].unionByName(half[1]).groupBy(*cols[:-1]).agg(F.sum("n").alias("n"))
    assert Counter(map(tuple, both.select(cols).collect())) == Counter(map(tuple, once.collect()))


# 5


def test_language(spark, docs, rows, nothing):
    got = language.language_rows(docs).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    assert all((r["lang_pred"] == "und") == (r["score"] == 0) for r in got)
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode() if r["doc_id"] is not None else b"") % 4 == 2)
    assert {r["lang_pred"] for r in got if r["doc_id"] in (60, 61, 62)} == {"und"}
    assert language.language_rows(nothing).count() == 0
    assert {r["lang_pred"] for r in language.language_rows(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_language_accuracy(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = language.language_rows(d).join(d.select("doc_id", "lang"), "doc_id").filter("held_out")
    assert held.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97


def test_presence_stays_inside_a_text():
    texts = ["hello", "xyz", "", "ab", "é" * 40, "hello", "a b,c 1"]
    together = language.presence(texts)
    for i, t in enumerate(texts):
        assert (together[i] == language.presence([t])[0]).all()
        data = b" " + t.lower().encode().translate(language.PLAIN) + b"   "
        grams = {data[i : i + n] for n in (1, 2, 3, 4) for i in range(len(data) - 3)}
        assert together[i].sum() <= len(grams) and together[i].sum() > 0.95 * len(grams)


def test_language_does_not_depend_on_neighbours(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", F.substring("text", 1, 40).alias("text"), "lang")
    model = language.fitted(d)
    told = lambda x: {(r["doc_id"], r["lang_pred"], r["score"]) for r in language.predicted(x, model).collect()}
    once = told(d)
    assert told(d.orderBy(F.desc("text"))) == told(d.repartition(7)) == told(d.unionAll(d).unionAll(d)) == told(d.orderBy("lang").repartitionByRange(13, "text")) == once
    again = language.fitted(d.unionAll(d).repartition(3))
    assert (again.landmarks == model.landmarks).all() and (again.weights == model.weights).all()


def test_language_kernel_and_ridge():
    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice(list(a)) for _ in range(60)) for a in ("abcd ", "cdef ", "efgh ") for _ in range(40)]
    labels = np.repeat([0, 1, 2], 40)
    bits = language.presence(texts)
    model = language.Model(["x", "y", "z"], np.packbits(bits, axis=1), labels)
    sets = [set(np.flatnonzero(b)) for b in bits]
    at = np.unique(np.linspace(0, 119, min(language.LANDMARKS, 120)).astype(int))
    k = np.array([[len(sets[i] & sets[j]) / np.sqrt(len(sets[i]) * len(sets[j])) for j in at] for i in range(120)])
    # ridge regression in the landmark space, by its normal equations: (K'K + r K_mm) w + K'1 b = K'y, balanced languages
    kmm, y = k[at], np.where(labels[:, None] == np.arange(3), 1.0, -1.0)
    one = np.ones((120, 1))
    left = np.block([[k.T @ k + language.RIDGE * kmm, k.T @ one], [one.T @ k, one.T @ one]])
    solved = np.linalg.lstsq(left, np.vstack([k.T @ y, one.T @ y]), rcond=None)[0]
    want = k @ solved[:-1] + solved[-1]
    e = np.exp(language.SHARPNESS * (want - want.max(axis=1, keepdims=True)))
    assert np.allclose(model.scores(bits, model.unpacked()), e / e.sum(axis=1, keepdims=True), atol=1e-3)


def test_language_sample_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(language, "PER_LANGUAGE", 5)
    monkeypatch.setattr(language, "SAMPLE", 12)
    rows = [(i, f"text {i}", f"l{i % 3}") for i in range(300)] + [(None, "same", "l1")] * 50 + [(1, "same", "l3")] * 50
    keys = language.sample_keys(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4))
    n = Counter(r["lang"] for r in keys.collect())
    assert set(n) == {"l0", "l1", "l2", "l3"} and max(n.values()) <= 3 and sum(n.values()) <= 12
    many = spark.createDataFrame([(i, f"text {i}", f"l{i}") for i in range(40)], "doc_id long, text string, lang string")
    held = {i for i in range(40) if zlib.crc32(str(i).encode()) % 4 == 2}
    assert {r["lang"] for r in language.sample_keys(many).collect()} == {f"l{i}" for i in range(40) if i not in held}


def test_language_without_letters(spark):
    odd = ["²", "½", "①", "Ⅷ", "123 ,.", "٣", "_", "😀"]
    rows = [(i, t, "en") for i, t in enumerate(odd)] + [(100 + i, f"word number {i}", "en") for i in range(20)] + [(200, "é", "fr")]
    got = {r["doc_id"]: r["lang_pred"] for r in language.language_rows(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert {got[i] for i in range(len(odd))} == {"und"} and got[200] != "und" and got[100] != "und"


# 6


def filled(sizes):
    """Targets by capping round after round."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    want, target, free = 1.5 * sum(sizes.values()), {}, set(order)
    while free:
        left = want - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * sizes[s]}
        target |= {s: 2.0 * sizes[s] for s in over} if over else share
        free -= over or free
    return target


def test_mix(docs, rows, nothing):
    got = [r.asDict() for r in mixing.mix_rows(docs).collect()]
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
    want = filled(dict(sizes))
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((r[0], len(words(r[1]))) for r in rows)
    assert all(0 <= r["taken"] <= 2 * r["size"] and r["taken"] % max(1, r["size"]) == 0 for r in got)
    by = defaultdict(int)
    for r in got:
        by[round(r["target"], 6)] += r["taken"]
    largest = max(len(words(r[1])) for r in rows)
    assert sorted(by) == sorted({round(t, 6) for t in want.values()})
    assert all(abs(t - n) <= largest for t, n in by.items())
    again = [r.asDict() for r in mixing.mix_rows(docs.repartition(5)).collect()]
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["taken"])
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert mixing.mix_rows(nothing).count() == 0
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns and sum(len(words(r["text"])) for r in mixed.collect()) == sum(r["taken"] for r in got)


def test_mix_does_not_depend_on_file_splits(spark):
    rows = [(None, "a b " * (i % 3) + "x" * (i % 4), "s") for i in range(200)] + [(3, "one two three", "s")] * 40
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    once, again = (Counter((r["text"], r["n"]) for r in mixing.mixed(x).groupBy("text").agg(F.count("*").alias("n")).collect()) for x in (d.repartition(3), d.orderBy(F.desc("text")).repartition(7)))
    assert once == again


def test_pivot_is_unbiased(spark):
    hits = Counter()
    base = mixing.SEED
    try:
        for seed in range(12):
            mixing.SEED = base + seed
            rows = spark.createDataFrame([(i, i * 7919, "a", 1 + i % 5, 900, 450.0) for i in range(300)], "rid long, h long, __source string, size long, source_size long, target double")
            for r in mixing.taken_copies(rows.withColumn("h", F.xxhash64(F.lit(seed), "rid"))).collect():
                hits[r["rid"] % 5] += r["copies"]
    finally:
        mixing.SEED = base
    assert all(abs(hits[k] / (60 * 12) - 0.5) < 0.1 for k in range(5))


# 7


def test_simhash(docs, rows, nothing):
    got = simhash.simhash_rows(docs).collect()
    prints = {}
    for r in rows:
        ws = words(re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or ""))
        hs = [xxhash.xxh64_intdigest(" ".join(ws[i : i + 4]).encode(), 42) for i in range(max(1, len(ws) - 3))] if ws else []
        prints.setdefault(r[0], []).append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)))
    assert Counter((r["doc_id"], r["fingerprint"]) for r in got) == Counter((d, f"{p:016x}") for d, ps in prints.items() for p in ps)
    nodes = sorted({p for ps in prints.values() for p in ps})
    parent = {p: p for p in nodes}

    def root(p):
        while parent[p] != p:
            p = parent[p]
        return p

    for a, b in itertools.combinations(nodes, 2):
        if (a ^ b).bit_count() <= 4:
            parent[root(a)] = root(b)
    least = {}
    for d, ps in prints.items():
        for p in ps:
            least[root(p)] = min((x for x in (least.get(root(p)), d) if x is not None), default=None)
    assert all(r["component_id"] == least[root(int(r["fingerprint"], 16))] for r in got)
    assert simhash.simhash_rows(nothing).count() == 0
    once = simhash.deduplicated(docs)
    assert once.columns == docs.columns and once.count() == len({root(p) for ps in prints.values() for p in ps})


def test_anchors_lose_no_link():
    rng = random.Random(3)
    masks = simhash._masks(simhash.RADIUS + simhash.HALF_THRESHOLD)
    base = [rng.getrandbits(64) for _ in range(40)]
    near = [b ^ sum(1 << i for i in rng.sample(range(64), rng.randint(1, 4))) for b in base]
    prints = np.array(base + near, dtype=np.uint64).view(np.int64)
    linked = simhash.links_at(simhash._replicas(prints, masks))
    parent = {int(p): int(p) for p in prints}

    def root(p):
        while parent[p] != p:
            p = parent[p]
        return p

    for a, b in linked:
        assert int(np.uint64(np.int64(a)) ^ np.uint64(np.int64(b))).bit_count() <= 4
        parent[root(a)] = root(b)
    assert all(root(int(prints[i])) == root(int(prints[i + 40])) for i in range(40))


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 200), (200, 150), (7, 7)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and got[200] == got[150] == got[100] == 100
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


# 8


def test_attribution(docs, rows, nothing):
    from tokenizers import Tokenizer

    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    whole.encode_special_tokens = True
    got = defaultdict(float)
    chars = Counter()
    for r in attribution.section_tokens(docs, path, pattern).collect():
        got[r["doc_id"]] += r["n_tokens"]
        chars[r["doc_id"]] += r["n_chars"]
    want, letters = Counter(), Counter()
    for r in rows:
        want[r[0]] += len(whole.encode(r[1] or "", add_special_tokens=False).ids)
        letters[r[0]] += len(r[1] or "")
    assert got == want and chars == letters
    assert attribution.section_tokens(nothing, path, pattern).count() == 0


def spans_of(whole, text):
    """Byte spans of the tokens of a text, from the library's own character offsets where they are exact, else by tokens' bytes."""
    inverse = {c: b for b, c in byte_letters().items()}
    ids = whole.encode(text, add_special_tokens=False).ids
    at, out = 0, []
    for i in ids:
        n = len([inverse[c] for c in whole.id_to_token(i)])
        out.append((at, at + n))
        at += n
    return out


def byte_letters():
    """The byte-level alphabet: printable bytes stand for themselves, the others for characters from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}


@pytest.mark.parametrize("rule", ["majority", "start", "split"])
def test_attribution_by_section(spark, rule):
    """Every section's tokens, characters and crossings against a count byte by byte."""
    from tokenizers import Tokenizer

    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    whole.encode_special_tokens = True
    rng = random.Random(6)
    parts = ["word", " the", "\n", "\n\n", "  ", "é", "日本", "😀", "\r\n", "\t", ".", "\n\n\n  x"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(120)] + ["", None, "\n", "\n\n", "a\n", "x" * 5000]
    table = spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(texts)], "doc_id string, text string").withColumn("section", F.lit("clash"))
    got = {(r["doc_id"], r["section"]): (r["start_char"], r["n_chars"], round(r["n_tokens"], 9), r["n_crossing"]) for r in attribution.section_tokens(table, path, pattern, rule).collect()}
    want = {}
    for d, text in enumerate(t or "" for t in texts):
        lines = text.split("\n")
        sections = [x + "\n" for x in lines[:-1]] + ([lines[-1]] if lines[-1] or len(lines) == 1 else [])
        owner = [k for k, x in enumerate(sections) for _ in x.encode()]
        tokens_, crossing = Counter(), Counter()
        for a, b in spans_of(whole, text):
            held = Counter(owner[a:b])
            to = {"majority": min(held, key=lambda k: (-held[k], k)), "start": owner[a]}.get(rule)
            for k in held if rule == "split" else [to]:
                tokens_[k] += held[k] / (b - a) if rule == "split" else 1
                crossing[k] += len(held) > 1
        at = 0
        for k, x in enumerate(sections):
            want[f"d{d}", k] = (at, len(x), round(float(tokens_[k]), 9), crossing[k])
            at += len(x)
    assert got == want


def test_attribution_rules():
    starts, ends = np.array([0, 4, 6]), np.array([3, 7, 10])  # the token 3..7 covers 1, 2 and 1 bytes
    assert attribution.attributed(ends, starts, 10)[0].tolist() == [1, 1, 1]
    assert attribution.attributed(ends, starts, 10, "start")[0].tolist() == [2, 0, 1]
    assert attribution.attributed(ends, starts, 10, "split")[0].tolist() == [1.25, 0.5, 1.25]
    assert attribution.attributed(np.array([2]), np.array([0, 1]), 2)[0].tolist() == [1, 0]


# 9


def removed(rows):
    """Spans by document from a table of all 50-byte strings."""
    docs = [(r[0], (r[1] or "").encode()) for r in rows]
    first = {}
    for i, t in docs:
        if i is not None:
            for k in range(len(t) - 49):
                w = t[k : k + 50]
                first[w] = min(first.get(w, i), i)
    out = []
    for i, t in docs:
        gone = bytearray(len(t))
        for k in range(len(t) - 49):
            if i is not None and first[t[k : k + 50]] < i:
                gone[k : k + 50] = b"\1" * 50
        out.append((i, len(t), hashlib.sha256(bytes(b for b, g in zip(t, gone, strict=True) if not g)).hexdigest(), sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))))
    return Counter(out)


def test_substrings(spark, docs, rows, nothing):
    got = substrings.deduplicated(docs.select("doc_id", "text", "size", "bucket"))
    assert Counter((r["doc_id"], r["n_bytes"], hashlib.sha256(r["kept"]).hexdigest(), len(r["spans"])) for r in got.collect()) == removed(rows)
    assert substrings.deduplicated(nothing).count() == 0


def test_substrings_of_periodic_texts(spark):
    rng = random.Random(9)
    texts = ["ab" * 300, "ab" * 40 + "x" + "ab" * 300, "a" * 2000, "b" + "a" * 700, "".join(rng.choice("ab") for _ in range(3000)) + "ab" * 60, None, "ab" * 24, "ab" * 25]
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, "ab" * 300), (None, "a" * 100)]
    got = substrings.deduplicated(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter((r["doc_id"], r["n_bytes"], hashlib.sha256(r["kept"]).hexdigest(), len(r["spans"])) for r in got.collect()) == removed(rows)


def test_merge_keeps_order():
    rng = random.Random(8)
    for k in (1, 2, 3, 5, 8):
        runs = [sorted("".join(rng.choice("ab") for _ in range(rng.randint(8, 12))).encode() for _ in range(rng.randint(0, 20))) for _ in range(k)]

        def coded(run):
            last = b""
            for key in run:
                yield key, substrings.shared_prefix(last, key), 0, 0, 0
                last = key

        got = [(e[0], shared) for _, e, shared in substrings.merge([coded(r) for r in runs])]
        want = sorted(x for r in runs for x in r)
        assert got == [(x, substrings.shared_prefix(y, x)) for x, y in zip(want, [b"", *want])]


def by_hand(rows, buckets, fan, parts, crowded, monkeypatch):
    """The stages of the operator in this process, with any number of levels."""
    monkeypatch.setattr(substrings, "FAN_IN", fan)
    monkeypatch.setattr(substrings, "CROWDED", crowded)
    levels = substrings.Levels(buckets, parts)
    made = []
    for b in range(buckets):
        mine = [(i, t.encode()) for i, t in rows if i is not None and t and len(t.encode()) >= 50 and i % buckets == b]
        if mine:
            made.append(substrings.Bucket(np.array([i for i, _ in mine]), [t for _, t in mine], b))
    counts = Counter()
    for b in made:
        for p, short, _, n in b.short_anchors(2):
            counts.update(dict(zip([(p, x) for x in short.tolist()], n.tolist())))
    groups = defaultdict(list)
    for b in made:
        wanted = {p: (short, np.array([counts[p, x] >= crowded for x in short.tolist()])) for p, short, _, _ in b.short_anchors(2)}
        for key, blob in b.blobs(wanted, 2, levels):
            groups[key].append(blob)
    for level in range(1, levels.depth + 1):
        after = defaultdict(list)
        for key, blobs in groups.items():
            assert key < 0 or len(blobs) <= 2 * fan  # an ordinary and a split run of each
            for k, blob in [(key, x) for x in blobs] if key < 0 else substrings.decided(blobs) if level == levels.depth else substrings.joined_runs(blobs, key >> 32, level, levels):
                after[k].append(blob)
        groups = after
    spans = np.concatenate([np.empty(0, dtype=substrings.SPAN), *(np.frombuffer(substrings.unpacked(x, 1)[1][0], dtype=substrings.SPAN) for blobs in groups.values() for x in blobs)])
    return levels.depth, Counter((int(r["id"]), int(r["text"]), int(r["start"]), int(r["stop"])) for r in substrings.merged_spans(spans))


@pytest.mark.parametrize("buckets,fan,parts,crowded", [(1, 64, 1, 10**9), (7, 64, 3, 10**9), (9, 3, 4, 10**9), (20, 3, 5, 10**9), (20, 3, 9, 5), (7, 2, 3, 1), (5, 64, 2, 2)])
def test_levels_and_crowded_anchors(rows, buckets, fan, parts, crowded, monkeypatch):
    rng = random.Random(13)
    sentence = made_up(rng, 300)
    line = sentence(14)
    mine = [(r[0], r[1]) for r in rows if r[1] is None or len(r[1]) < 20_000] + [(200 + i, f"{sentence(6)} {line} {sentence(6)}" * (1 + i % 2)) for i in range(60)] + [(300, "ab" * 300), (301, "ab" * 200 + "x" + "ab" * 90)]
    depth, got = by_hand(mine, buckets, fan, parts, crowded, monkeypatch)
    assert depth == max(substrings.LEAST_LEVELS, int(np.ceil(np.log(buckets) / np.log(fan) - 1e-9)))
    want = Counter()
    first = {}
    docs = [(i, (t or "").encode()) for i, t in mine if i is not None]
    for i, t in docs:
        for k in range(len(t) - 49):
            first[t[k : k + 50]] = min(first.get(t[k : k + 50], i), i)
    for i, t in set(docs):
        gone = np.zeros(len(t) + 2, dtype=np.int8)
        for k in range(len(t) - 49):
            if first[t[k : k + 50]] < i:
                gone[k + 1 : k + 51] = 1
        edges = np.flatnonzero(np.diff(gone))
        want.update((i, xxhash.xxh64_intdigest(t), int(a), int(b)) for a, b in zip(edges[::2], edges[1::2]))
    assert got == want


# 10


def test_leaks(spark, docs, nothing):
    rng = random.Random(5)
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    items = [(r["item_id"], r["text"]) for r in bench.collect()]
    plain = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    clean = [t for t in plain if not any(" ".join(decontaminate.words_of(x)) in " ".join(decontaminate.words_of(t)) for _, x in items)][:60]
    vocabulary = [w for t in clean for w in t.split()]

    def paraphrase(text):
        return " ".join(rng.choice(vocabulary) if rng.random() < 0.2 else w for w in text.split())

    leaky = [(1000 + i, f"{clean[i]} {x.upper() if i % 3 == 0 else x} {clean[i + 1]}", i) for i, (_, x) in enumerate(items[:12])] + [(2000 + i, f"{clean[i + 2]} {paraphrase(x)}", i) for i, (_, x) in enumerate(items[12:24], 12)]
    table = spark.createDataFrame([(i, t) for i, t in enumerate(clean)] + [(i, t) for i, t, _ in leaky] + [leaky[0][:2], (None, None), (5000, ""), (5001, "x " * 50_000)], "doc_id long, text string").withColumn("item_id", F.lit(1))
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(table, bench).collect()}
    want = {(i, items[k][0]) for i, _, k in leaky}
    assert found >= {x for x in want if x[0] < 2000} and len(want - found) <= 1 and not {x for x in found if x[0] < 1000}
    left = decontaminate.decontaminated(table, bench)
    assert left.columns == table.columns and left.filter("doc_id < 1000").count() == len(clean) and left.filter("doc_id is null").count() == 1
    assert decontaminate.leaks(nothing, bench).count() == 0
    assert decontaminate.leaks(docs, bench.limit(0)).count() == 0
    odd = spark.createDataFrame([(1, None), (2, ""), (None, "one two three")], "item_id long, text string")
    assert decontaminate.leaks(docs, odd).count() == 0


def test_singular_vectors():
    rng = np.random.default_rng(3)
    a = rng.standard_normal((500, 6)) @ np.diag([9, 7, 5, 3, 2, 1.0]) @ np.linalg.qr(rng.standard_normal((40, 6)))[0].T
    random = rng.standard_normal((40, 12))
    values, vectors = decontaminate.singular_vectors(a.T @ (a @ random), random)
    _, want, right = np.linalg.svd(a, full_matrices=False)
    assert np.allclose(values[:6], want[:6], rtol=1e-4)
    assert np.allclose(np.abs(np.sum(vectors[:, :6] * right[:6].T, axis=0)), 1, atol=1e-4)


def test_common_length():
    a = np.array([1, 2, 3, 4, 5], dtype=np.int32)
    assert decontaminate.common_length(a, np.array([9, 1, 3, 9, 5], dtype=np.int32)) == 3
    assert decontaminate.common_length(a, a[:0]) == 0


def test_near_duplicates_by_shingles(spark, docs, nothing):
    from strophe.llm import neardup

    rng = random.Random(5)
    texts = []
    for _ in range(40):
        words = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(rng.randint(8, 250))]
        texts += [" ".join(words)]
        for edits in (1, 2, 3, 4):
            copy = list(words)
            for at in rng.sample(range(len(words)), edits):
                copy[at] = f"new{rng.random()}"
            texts += [" ".join(copy), " ".join(copy[edits:])]
    line = " ".join(f"l{i}" for i in range(12))
    texts += [f"{line} w{i} x{i}" for i in range(30)] + [None, "", " \n", "a b", "A  b"]
    rng.shuffle(texts)
    sets = [neardup.shingle_set(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        return x if root[x] == x else find(root[x])

    far = 0
    for i in range(len(texts)):
        for j in range(i):
            both, either = len(np.intersect1d(sets[i], sets[j])), len(np.union1d(sets[i], sets[j]))
            if either == 0 or both / either >= 0.8:
                root[max(find(i), find(j))] = min(find(i), find(j))
                a, b = (int.from_bytes(simhash.fingerprint(texts[x])) for x in (i, j))
                far += (a ^ b).bit_count() > simhash.THRESHOLD
    assert far > 20  # links that the digest of op7 does not make
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    once = neardup.deduplicated(table)
    assert sorted(r["doc_id"] for r in once.collect()) == [i for i in range(len(texts)) if find(i) == i]
    assert neardup.deduplicated(nothing).count() == 0
    assert neardup.deduplicated(docs).columns == docs.columns


def test_near_duplicates_come_through_simhash(spark):
    """The pairs of the stage's first step are the fingerprints' links, over its own shingles, in any number of rounds."""
    from strophe.llm import neardup

    rng = random.Random(3)
    plain = [[f"w{rng.randrange(4000)}" for _ in range(300)] for _ in range(12)]
    texts = [" ".join(w) for w in plain] + [" ".join([*w[:9], f"n{i}", *w[10:]]) for i, w in enumerate(plain)]
    prints = [int.from_bytes(simhash.fingerprint(t, neardup.SHINGLE), signed=True) for t in texts]
    sizes = [len(neardup.shingle_set(t)) for t in texts]
    base = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "rid long, doc_id long, text string")
    made = neardup.with_prefixes(base, neardup.common_shingles(base, neardup.SHINGLE), neardup.SHINGLE, neardup.SIMILAR)
    assert {r["rid"]: r["fp"] for r in made.collect()} == dict(enumerate(prints))
    nodes = spark.createDataFrame(list(zip(range(24), sizes, prints, strict=True)), "node long, n long, fp long")
    near = {(i, j, sizes[i] + sizes[j]) for i in range(24) for j in range(i + 1, 24) if (prints[i] ^ prints[j]).bit_count() <= simhash.THRESHOLD}
    for limit in (1 << 30, 1 << 16):
        assert {tuple(r) for r in neardup.print_pairs(nodes, limit).collect()} == near and len(near) >= 6


def test_near_duplicates_of_few_words(spark, monkeypatch):
    """Long texts of a small vocabulary meet at many shingles: few pairs are verified, in whatever rounds, and no link goes."""
    from strophe.llm import neardup

    rng = random.Random(8)
    plain = [[rng.choice("abcdefghijkl") for _ in range(rng.randint(1200, 1500))] for _ in range(50)]
    near = [[*words[:20], "new", *words[21:]] for words in plain[:5]]
    table = spark.createDataFrame([(i, " ".join(words)) for i, words in enumerate(plain + near)], "doc_id long, text string")
    sent, kept = [], neardup.verified
    monkeypatch.setattr(neardup, "verified", lambda pairs, *rest: (sent.append(pairs.count()), kept(pairs, *rest))[1])
    base = table.withColumn("rid", F.col("doc_id"))
    found = {r["rid"]: r["root"] for r in neardup.roots(base, limit=16 << 20).collect()}
    assert found == {i: i - 50 if i >= 50 else i for i in range(55)}
    assert sum(sent) <= 10  # one place in common made 610 of them
    assert found == {r["rid"]: r["root"] for r in neardup.roots(base, limit=1 << 17).collect()}


def test_encoder_equals_the_tokenizer_on_every_byte():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    own, whole = tokens.Encoder(path), Tokenizer.from_file(path)
    for c in map(chr, range(256)):
        for text in (c, f"ab{c}cd", f"ab {c} cd", f"{c}{c}1", f"a. {c}!"):
            assert np.frombuffer(own.encode(text), dtype="<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, repr(text)


def test_clean_rows_stay_beside_leaking_rows_of_their_id(spark):
    rng = random.Random(3)
    text = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n))
    item = text(40)
    rows = [(None, f"{text(30)} {item} {text(20)}"), (None, text(90)), (7, item), (7, text(80)), (7, None), (8, text(50))] + [(100 + i, text(120)) for i in range(40)]
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    left = decontaminate.decontaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench)
    assert Counter(tuple(r) for r in left.collect()) == Counter(r for r in rows if item not in (r[1] or ""))


@pytest.mark.parametrize("n", [97, 150, 226, 300, 1000])
def test_long_items_are_found(spark, n):
    rng = random.Random(n)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(3000)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    item = text(n)
    rows = [(0, item), (1, f"{text(61)} {item} {text(20)}"), (2, text(3000))] + [(10 + i, text(200)) for i in range(40)]
    bench = spark.createDataFrame([(1, item), (2, text(30))], "item_id long, text string")
    found = decontaminate.leaks(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()
    assert {(r["doc_id"], r["item_id"], r["n_common"], r["n_item"]) for r in found} == {(0, 1, n, n), (1, 1, n, n)}


def made_up(rng, n_words=4000):
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n_words)]
    weights = [1 / (i + 3) for i in range(n_words)]
    return lambda n: " ".join(rng.choices(vocabulary, weights, k=n))


def test_leaks_of_many_items_against_all_pairs(spark):
    """Over 500 items, short and long, verbatim and paraphrased: every pair that the checks accept, found or counted as missed."""
    rng = random.Random(21)
    text = made_up(rng)
    items = [(i, f"{text(rng.choice([12, 20, 40, 90, 150, 260]))}. {text(8)}") for i in range(620)]

    def told(x, kind):
        ws = x.split()
        return " ".join(w if kind == "verbatim" or rng.random() > 0.15 else text(1) for w in ws)

    planted = {2 * i: (i, ("verbatim", "paraphrase")[i % 2]) for i in range(0, 620, 2)} | {2 * i + 1: (i, "verbatim") for i in range(0, 620, 31)}
    rows = [(d, f"{text(60)} {told(items[i][1], kind)} {text(50)}") for d, (i, kind) in planted.items()] + [(10_000 + i, text(200)) for i in range(150)]
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    known = decontaminate.Items([x for _, x in items])
    want = set()
    for d, t in rows:
        ids = np.array([known.number.get(w, -1) for w in decontaminate.words_of(t)], dtype=np.int32)
        have = Counter(ids.tolist())
        for i, w in enumerate(known.words):
            if sum(min(n, have[x]) for x, n in Counter(w.tolist()).items()) >= decontaminate.MIN_COMMON * len(w) and decontaminate.verdict(w, known.answers[i], ids, 0, len(ids))[2]:
                want.add((d, i))
    sure = {(d, i) for d, (i, kind) in planted.items() if kind == "verbatim"}
    told_ = {(d, i) for d, (i, kind) in planted.items() if kind == "paraphrase"}
    assert sure <= found and len(told_ & found) >= 0.9 * len(told_ & want) and len(found & want) >= 0.9 * len(want)
    assert not {d for d, _ in found if d >= 10_000} - {d for d, _ in want}


def test_cosines_do_not_depend_on_blocks(monkeypatch):
    rng = random.Random(4)
    text = made_up(rng, 500)
    items = decontaminate.Items([text(rng.choice([5, 30, 120])) for _ in range(40)])
    passages = [np.array([items.number.get(w, -1) for w in text(300).split()], dtype=np.int32) for _ in range(30)]
    weights = decontaminate.Weights(items, np.arange(len(items.number)) % 7 + 1, 10_000)
    _, start, term, value, _ = weights.rows(passages)
    basis = np.linalg.qr(np.random.default_rng(1).standard_normal((weights.terms, 16)))[0].astype(np.float32)
    space = decontaminate.Space(items, weights, basis)
    rows = np.zeros((len(start), weights.terms), dtype=np.float32)
    rows[np.repeat(np.arange(len(start)), np.diff(np.r_[start, len(term)])), term] = value
    told = []
    for n in (1, 7, 1000):
        monkeypatch.setattr(decontaminate, "ITEMS_AT_ONCE", n)
        told.append(np.hstack([space.cosines(lo, rows @ basis, rows @ q) for lo, q in space.blocks()]))
    assert np.allclose(told[0], told[1], atol=1e-5) and np.allclose(told[0], told[2], atol=1e-5)
    for j, (t, v) in enumerate(space.vectors):  # by hand: project on the vectors and the query, then take the cosine
        q = np.zeros(weights.terms)
        q[t] = v
        span = np.linalg.qr(np.hstack([basis, q[:, None]]))[0]
        inside = rows @ span @ span.T
        assert np.allclose(told[0][:, j], inside @ q / np.maximum(np.linalg.norm(inside, axis=1), 1e-9), atol=2e-3)


@pytest.mark.parametrize("kind,ids", [("string", ["", "b", None]), ("decimal(9,2)", [None, 1, 2]), ("date", [None, None, None]), ("array<int>", [[1], [], None])])
def test_odd_item_ids_and_clashing_columns(spark, kind, ids):
    import decimal

    text = made_up(random.Random(8))
    items = [text(30) for _ in ids]
    bench = spark.createDataFrame([(decimal.Decimal(i) if kind.startswith("dec") and i else i, x) for i, x in zip(ids, items, strict=True)], f"item_id {kind}, text string")
    table = spark.createDataFrame([(f"d{k}", f"{text(40)} {x}", k) for k, x in enumerate(items)] + [(None, text(90), 9)], "doc_id string, text string, item int")
    for c in ("item_id", "cosine", "rid", "ids", "n_common"):
        table = table.withColumn(c, F.lit("clash"))
    found = decontaminate.leaks(table, bench)
    assert found.columns == ["doc_id", "item_id", "n_common", "n_item", "at_word", "cosine"]
    assert sorted((r["doc_id"], str(r["item_id"])) for r in found.collect()) == sorted((f"d{k}", str(r["item_id"])) for k, x in enumerate(items) for r in bench.collect() if r["text"] == x)
    left = decontaminate.decontaminated(table, bench)
    assert left.columns == table.columns and [r["item"] for r in left.collect()] == [9]
