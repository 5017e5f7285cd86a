"""Merkle manifest, SentencePiece by prefix tables, and the prefix trie, each against brute force."""

import hashlib
import random
import zlib
from collections import defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from strophe.llm import manifest, pieces, trie

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# 11


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def levels_of(hashes):
    out = [hashes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + 3])) for i in range(0, len(out[-1]), 3)])
    return out


def climb(levels, at, leaf):
    """The siblings of a leaf from below, and what another leaf in its place folds to."""
    siblings = []
    for level in levels[:-1]:
        run = level[at // 3 * 3 : at // 3 * 3 + 3]
        siblings += run[: at % 3] + run[at % 3 + 1 :]
        leaf = sha("".join(run[: at % 3] + [leaf] + run[at % 3 + 1 :]))
        at //= 3
    return siblings, leaf


def brute_manifest(rows):
    trees = defaultdict(list)
    for doc_id, text, lang, source, n_chars in rows:
        own = [doc_id, source, lang, n_chars, text]
        odd = doc_id is None or text is None or zlib.crc32(str(doc_id).encode()) % 2
        changed = own if odd else [*own[:-1], text.replace("\n", "")]
        trees[(source is not None, (source or "").encode())].append((doc_id, *(sha("".join(map(field, x))) for x in (own, changed))))
    for t in trees.values():
        t.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    built = {k: levels_of([x[1] for x in trees[k]]) for k in sorted(trees)}
    top = levels_of([x[-1][0] for x in built.values()])
    out = []
    for at, (k, levels) in enumerate(built.items()):
        for i, (doc_id, leaf, changed) in enumerate(trees[k]):
            low, now = climb(levels, i, changed)
            high, now = climb(top, at, now)
            out.append((doc_id, leaf, levels[-1][0], top[-1][0], sha("".join(low + high)), now, now == top[-1][0]))
    return sorted(out, key=str)


@pytest.mark.parametrize("band", [1, 2, 8])
def test_manifest(docs, rows, nothing, band, monkeypatch):
    monkeypatch.setattr(manifest, "BAND", band)
    monkeypatch.setattr(manifest, "BLOCK", 3**band)
    got = manifest.proofs(docs)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    want = brute_manifest([r[:5] for r in rows])
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert {r[-1] for r in want} == {True, False}
    assert manifest.proofs(nothing).count() == 0


def test_manifest_of_many_sources(spark, monkeypatch):
    monkeypatch.setattr(manifest, "BAND", 2)
    monkeypatch.setattr(manifest, "BLOCK", 9)
    rows = [(i, f"text\n{i}", None, f"s{i % 40:02d}" if i % 3 else "hot", i) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(map(tuple, manifest.proofs(docs).collect()), key=str) == brute_manifest(rows)
    one = docs.filter("source = 'hot'")
    assert sorted(map(tuple, manifest.proofs(one).collect()), key=str) == brute_manifest([r for r in rows if r[3] == "hot"])
    single = docs.limit(1).collect()
    assert sorted(map(tuple, manifest.proofs(spark.createDataFrame(single, docs.schema)).collect()), key=str) == brute_manifest([tuple(single[0])])


# 12


@pytest.fixture(scope="module")
def model():
    return pieces.Pieces(MODEL)


def test_prefix_table_equals_the_library(model):
    rng = random.Random(3)
    odd = ["a", "b", " ", "  ", "▁", "\n", "\r", "\t", "é", "ß", "日本", "😀", "\x00", "<0x0A>", "</s>", "1", "aa", "==", "----", " the", "ing", "　", "ﬁ", "́"]
    known = [p.replace("▁", " ") for p in model.rank]
    for parts, most in ((odd, 25), (known, 12), ("ab =-", 200)):
        for _ in range(2000):
            text = "".join(rng.choice(parts) for _ in range(rng.randint(0, most)))
            assert model.encode(text) == model.model.encode(text), text
    texts = ["", " ", "a b", "x\ny z", "no\n", "日本 語", " lead", "one two one two\n one"] * 3
    assert model.encode_all(texts).to_pylist() == model.model.encode(texts)
    assert model.encode_all([]).to_pylist() == [] and model.encode_all(["  two"]).to_pylist() == model.model.encode(["  two"])
    plain = ["", "a b", "x\ny z", "no\n", "日本 語", "one two one two\none"] * 3
    assert model.encode_all(plain).to_pylist() == model.model.encode(plain)
    for long in ("=" * 20_000, "x" * 20_001, " " * 9_999, "é\n" * 5_000):
        assert model.encode(long) == model.model.encode(long)


def test_what_is_remembered_is_bounded(model, monkeypatch):
    monkeypatch.setattr(pieces, "MOST_KNOWN", 10)
    monkeypatch.setattr(pieces, "MOST_PAIRS", 10)
    own = pieces.Pieces(MODEL)
    texts = [f"word{i} and w{i % 7}x more{i}" for i in range(300)]
    assert [own.encode(t) for t in texts] == model.model.encode(texts)
    assert len(own.known) <= 10 and len(own.older) <= 10 and sum(len(v[3]) for v in own.automaton.values()) <= 11


def test_sentencepiece_round_trip(docs, rows, nothing, model):
    got = pieces.decoded(pieces.encoded(docs, MODEL), MODEL)
    assert got.columns == [*docs.columns, "ids", "decoded"]
    found = sorted(((r["doc_id"], r["text"], r["ids"], r["decoded"]) for r in got.collect()), key=str)
    ids = [model.model.encode(r[1] or "") for r in rows]
    assert found == sorted(((r[0], r[1], i, model.model.decode(i) if i else "") for r, i in zip(rows, ids, strict=True)), key=str)
    both = pieces.round_trip(docs, MODEL)
    assert both.columns == got.columns and sorted(((r["doc_id"], r["text"], r["ids"], r["decoded"]) for r in both.collect()), key=str) == found
    again = pieces.encoded(docs.withColumn("ids", F.lit("own")), MODEL)
    assert dict(again.dtypes)["ids"] == "array<int>" and again.columns.count("ids") == 1
    assert pieces.decoded(pieces.encoded(nothing, MODEL), MODEL).count() == 0


# 13


def brute_trie(convs):
    """Nodes of (id, turns), turns of (key, bytes)."""
    nodes = defaultdict(list)
    for c, turns in convs:
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(c)
    kids = defaultdict(set)
    for k in nodes:
        if k:
            kids[k[:-1]].add(k)
    leaves, saved = defaultdict(int), defaultdict(int)
    for k, members in nodes.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not kids[k]
            saved[k[:d]] += (len(members) - 1) * k[-1][1] if k else 0
    ends = defaultdict(list)
    for c, turns in convs:
        ends[tuple(turns)].append(c)
    return sorted(
        ((min(m), len(k), min(nodes[k[:-1]]) if k else None, len(m), len(kids[k]), leaves[k], saved[k], sha(",".join(map(str, sorted(ends[k]))))) for k, m in nodes.items()),
        key=str,
    )


def rebuilt_plainly(rows):
    """(id, turns) as the fixed folds have it, from (id, turn, role, text)."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append(((turn is not None, turn or 0, sha(f"{len(role)}:{role}{text}")), (role, text), len(text.encode())))
    turns = {c: [(t, n) for _, t, n in sorted(x)] for c, x in own.items()}
    h = {c: zlib.crc32(str(c).encode()) % 9 for c in turns}
    return [(c, turns.get(c - c % 5, [])[: h[c]] + t[h[c] :]) for c, t in turns.items()]


OUT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def test_trie_of_conversations(spark):
    rng = random.Random(8)
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["ja ü", "no", "", None, "x" * 50])) for c in range(120) for t in range(rng.randint(1, 14)) if c % 35]
    rows += [(7, None, "user", "first"), (7, 3, "user", "tie"), (7, 3, "user", "tie"), (7, 3, "other", "tie"), (None, 1, "user", "lost"), (None, None, None, None)]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, depth string, n_convs int")
    got = trie.trie_nodes(trie.rebuilt(table))
    assert got.columns == OUT
    assert sorted(map(tuple, got.collect()), key=str) == brute_trie(rebuilt_plainly(rows))
    assert trie.trie_nodes(trie.rebuilt(table.limit(0))).count() == 0


@pytest.mark.parametrize("ranges", [1, 7, 60])
def test_trie_over_many_ranges(spark, ranges, monkeypatch):
    """A third of the conversations are copies, others extend them; nodes stay open over many ranges."""
    monkeypatch.setattr(trie, "RANGE_BYTES", 1)
    monkeypatch.setattr(trie, "buckets_for", lambda total, target: ranges)
    monkeypatch.setattr(trie, "PIECE", 7)
    rng = random.Random(ranges)
    hot = [rng.choice("ab") for _ in range(6)]
    made = [hot] * 200 + [hot[: rng.randint(0, 6)] + [rng.choice("abc") for _ in range(rng.randint(0, 5))] for _ in range(300)] + [[], []]
    convs = [(i * 3 + 1, [(k, ord(k)) for k in x]) for i, x in enumerate(made)]
    df = spark.createDataFrame([(c, [(k.encode(), n) for k, n in t]) for c, t in convs], f"conv_id long, turns {trie.TURNS}")
    assert sorted(map(tuple, trie.trie_nodes(df).collect()), key=str) == brute_trie(convs)
