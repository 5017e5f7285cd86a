"""Merkle manifest of a dataset, kept as parent preimages.

Rows are leaves.  In each tree (a source), every ``FAN`` consecutive nodes become the SHA-256 of their
concatenated hex digests; the roots of the sources are the leaves of one more tree.  For each parent its
*preimage* is stored: the children's digests, 64 characters each.  A proof needs no other table: a leaf joins
the preimages of its ancestors, cuts its own 64-character slot out of each to get the siblings, and puts another
digest into the slot to fold a changed leaf up to a root.

``BAND`` levels at a time are one exchange: the ``FAN ** BAND`` nodes of a block, or small trees together up to that
many nodes, meet in one group of bounded size.  Ranks inside a source come from ranges that are counted and offset on
their own, so a source of any size is many tasks.  Paths go down from the top: a block gets what lies above it
as rows, one for each level.

Defined cases: null values are ``-`` in a leaf; a null source is a tree of its own and comes first; null ids come first;
rows equal in source and id are ordered by their leaves, and repeated rows are leaves each; rows with a null id or text are not
tampered with; ids of any type count by their text; an empty table gives an empty result; other columns play no part.  If almost
every row is a source of its own, the paths take about 200 bytes for each row and level of the tree of sources.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import if_small, materialise

FAN, BAND, DIGEST = 3, 8, 64
BLOCK = FAN**BAND
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_digest(*values: Column) -> Column:
    """The digest of a row's values: ``-`` if null, else UTF-8 byte count, ``:`` and the value."""
    text = [v.cast("string") for v in values]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text)), 256)


def tampered_text(doc_id: Column, text: Column) -> Column:
    """Without its line breaks, where 2 divides the checksum of the id."""
    return F.when(F.crc32(doc_id.cast("string")) % 2 == 0, F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text)


def tree_key(source: Column) -> Column:
    """Sorts null first, then bytewise."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def leaves(docs: DataFrame) -> DataFrame:
    """(tree, doc_id, hash, changed) of each row, ranked inside its tree; ``n`` is the size of the tree."""
    own = [F.col(f) for f in FIELDS]
    changed = [*own[:-1], tampered_text(F.col("doc_id"), F.col("text"))]
    rows = docs.select(tree_key(F.col("source")).alias("tree"), "doc_id", leaf_digest(*own).alias("hash"), leaf_digest(*changed).alias("changed"), F.monotonically_increasing_id().alias("rid"))
    return ranked(rows, ["doc_id", "hash", "rid"]).drop("rid")


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``rank`` from 0 inside each tree and ``n``, the nodes of the tree."""
    ordered = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order).withColumn("seq", F.monotonically_increasing_id())
    ordered = materialise(ordered, "ranked").withColumn("part", F.shiftrightunsigned("seq", 33))
    ranges = ordered.groupBy("tree", "part").agg(F.count("*").alias("rows"), F.min("seq").alias("first"))
    by_tree = Window.partitionBy("tree")  # a row per range of the sort
    before = F.coalesce(F.sum("rows").over(by_tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = materialise(ranges.select(F.col("tree").alias("t"), F.col("part").alias("p"), (before - F.col("first")).alias("shift"), F.sum("rows").over(by_tree).alias("n")), "rank-offsets")
    found = ordered.join(if_small(offsets), (F.col("tree") == F.col("t")) & (F.col("part") == F.col("p")))
    return found.select(*rows.columns, (F.col("seq") + F.col("shift")).alias("rank"), "n")


def depth(n: int) -> int:
    """Levels from ``n`` nodes to one."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FAN), levels + 1
    return levels


def _bin(tree: Column, block: Column, n: Column, bins: int) -> Column:
    """The group of a block: its own, or where the tree is a block at most, one of ``bins`` that small trees share."""
    return F.when(n > BLOCK, F.concat(tree, F.lit(":"), block.cast("string"))).otherwise(F.pmod(F.xxhash64(tree), F.lit(bins)).cast("string"))


def _binned(nodes: DataFrame) -> DataFrame:
    small = nodes.filter(F.col("n") <= BLOCK).count()
    block = F.expr(f"rank div {BLOCK}")
    return nodes.withColumn("block", block).withColumn("bin", _bin(F.col("tree"), block, F.col("n"), max(1, -(-small // BLOCK))))


def _by_block(table: pa.Table, order: str) -> Iterator[tuple[tuple[str, int], dict[str, list]]]:
    """The blocks of a group, each with its columns in order."""
    table = table.sort_by([("tree", "ascending"), ("block", "ascending"), (order, "ascending")])
    columns = {c: table.column(c).to_pylist() for c in table.column_names}
    keys = list(zip(columns["tree"], columns["block"], strict=True))
    start = 0
    for i in range(1, len(keys) + 1):
        if i == len(keys) or keys[i] != keys[start]:
            yield keys[start], {c: v[start:i] for c, v in columns.items()}
            start = i


PARENTS = "bin string, tree string, block long, n long, level int, at long, preimage string"


def preimages(nodes: DataFrame, base: int = 0) -> DataFrame:
    """The parents in the ``BAND`` levels above ``nodes`` (tree, rank, n, hash, bin, block), which stand at level ``base``.

    ``at`` numbers the parents of a level in their tree; ``n`` is the number of nodes of the tree at ``base``.
    """

    kinds = to_arrow_schema(StructType.fromDDL(PARENTS))

    def fold(table: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        for (tree, block), columns in _by_block(table, "rank"):
            now, n, bin_ = columns["hash"], columns["n"][0], columns["bin"][0]
            for up in range(1, (BAND if n > BLOCK else depth(n)) + 1):
                parents = ["".join(now[i : i + FAN]) for i in range(0, len(now), FAN)]
                first = block * FAN ** (BAND - up)
                rows += [(bin_, tree, block, n, base + up, first + i, p) for i, p in enumerate(parents)]
                now = [hashlib.sha256(p.encode()).hexdigest() for p in parents]
        return pa.table([pa.array([r[i] for r in rows], kinds.field(i).type) for i in range(len(kinds))], schema=kinds)

    return nodes.select("bin", "tree", "block", "rank", "n", "hash").groupBy("bin").applyInArrow(fold, PARENTS)


def manifest(nodes: DataFrame) -> tuple[list[tuple[DataFrame, DataFrame]], DataFrame]:
    """The bands of all trees from the leaves up, each (nodes, preimages), written; and the roots (tree, hash, band).

    ``band`` is the one that holds a tree's root.
    """
    bands, roots = [], None
    while True:
        base = BAND * len(bands)
        nodes = _binned(nodes)
        parents = materialise(preimages(nodes, base), "preimages")
        ended = parents.filter((F.col("n") <= BLOCK) & (F.col("at") == 0)).groupBy("tree").agg(F.max_by("preimage", "level").alias("last"))
        found = ended.select("tree", F.sha2("last", 256).alias("hash")).unionByName(nodes.filter("n = 1").select("tree", "hash")).withColumn("band", F.lit(len(bands)))
        roots = found if roots is None else roots.unionByName(found)
        bands.append((nodes, parents))
        top = parents.filter((F.col("level") == base + BAND) & (F.col("n") > BLOCK))
        if not top.head(1):
            return bands, materialise(roots, "roots")
        nodes = materialise(top.select("tree", F.col("at").alias("rank"), F.ceil(F.col("n") / BLOCK).alias("n"), F.sha2("preimage", 256).alias("hash")), "block-roots")


#: Levels of the tree of sources count on from here.
TOP = 1000
ABOVE = "tree string, block long, level int, slot int, preimage string"


def _climbed(nodes: DataFrame, parents: DataFrame, above: DataFrame | None, run, schema: str) -> DataFrame:
    """``run(columns of a block, its preimages by level, what lies above it)`` gives the rows of each block of ``nodes``.

    The second is a list of (level, first number, preimages), the third one of (level, slot, preimage), both from below.
    """
    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def meet(table: pa.Table, ancestors: pa.Table) -> pa.Table:
        known = dict(_by_block(ancestors, "level"))
        rows: list[tuple] = []
        for key, columns in _by_block(table, "rank"):
            inside: dict[int, list[tuple[int, str]]] = {}
            higher = []
            of = known.get(key, {c: [] for c in ancestors.column_names})
            for level, at, slot, preimage in zip(of["level"], of["at"], of["slot"], of["preimage"], strict=True):
                if slot is None:
                    inside.setdefault(level, []).append((at, preimage))
                else:
                    higher.append((level, slot, preimage))
            rows += run(columns, [(level, min(inside[level])[0], [p for _, p in sorted(inside[level])]) for level in sorted(inside)], higher)
        return pa.table([pa.array([r[i] for r in rows], kinds.field(i).type) for i in range(len(kinds))], schema=kinds)

    inside = parents.select("bin", "tree", "block", "level", "at", F.lit(None).cast("int").alias("slot"), "preimage")
    if above is not None:
        at = nodes.select("tree", "block", "bin").distinct()
        placed = above.join(at.hint("merge"), ["tree", "block"])
        inside = inside.unionByName(placed.select("bin", "tree", "block", "level", F.lit(None).cast("long").alias("at"), "slot", "preimage"))
    return nodes.groupBy("bin").cogroup(inside.groupBy("bin")).applyInArrow(meet, schema)


def _steps(rank: int, inside: list) -> Iterator[tuple[int, int, str]]:
    """(level, slot, preimage) of a node's ancestors in its block."""
    for level, first, parents in inside:
        yield level, rank % FAN, parents[rank // FAN - first]
        rank //= FAN


def _path_rows(shift: int):
    """Rows of ``ABOVE`` for each node: it is a block of the nodes below."""

    def run(columns: dict[str, list], inside: list, higher: list) -> list[tuple]:
        out = []
        for tree, rank in zip(columns["tree"], columns["rank"], strict=True):
            out += [(tree, rank, level + shift, slot, p) for level, slot, p in _steps(rank, inside)] + [(tree, rank, *h) for h in higher]
        return out

    return run


def paths(bands: list[tuple[DataFrame, DataFrame]], above: DataFrame | None, shift: int = 0) -> list[DataFrame | None]:
    """What lies above the blocks of each band of some trees, down from ``above`` the trees (with ``band``, that of a root)."""
    found: list[DataFrame | None] = [None] * len(bands)
    for b in reversed(range(len(bands))):
        own = above.filter(F.col("band") == b).drop("band") if above is not None else None
        if b + 1 < len(bands):
            down = materialise(_climbed(*bands[b + 1], found[b + 1], _path_rows(shift), ABOVE), "paths")
            own = down if own is None else own.unionByName(down)
        found[b] = own
    return found


def _cut(preimage: str, slot: int) -> tuple[str, str]:
    """What stands before and after a slot."""
    return preimage[: DIGEST * slot], preimage[DIGEST * (slot + 1) :]


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


PROVED = "leaf string, subroot string, root string, proof_sha256 string, folded_root string"


def _proved(columns: dict[str, list], inside: list, higher: list) -> list[tuple]:
    cuts = [_cut(p, slot) for _, slot, p in higher]
    over = "".join(a + b for a, b in cuts)
    below = [p for level, _, p in higher if level < TOP]
    top = below[-1] if below else inside[-1][2][0] if inside else None
    out = []
    for doc_id, rank, leaf, changed in zip(columns["doc_id"], columns["rank"], columns["hash"], columns["changed"], strict=True):
        siblings, now = [], changed
        for _, slot, p in _steps(rank, inside):
            a, b = _cut(p, slot)
            siblings += (a, b)
            now = _sha(a + now + b)
        for a, b in cuts:
            now = _sha(a + now + b)
        subroot = leaf if top is None else _sha(top)
        out.append((doc_id, leaf, subroot, _sha(higher[-1][2]) if higher else subroot, _sha("".join(siblings) + over), now))
    return out


def proofs(docs: DataFrame) -> DataFrame:
    """Each row's leaf, roots and proof, and the root that its tampered leaf folds to."""
    bands, roots = manifest(leaves(docs))
    of_roots = ranked(roots.select(F.lit("").alias("tree"), F.col("tree").alias("of"), "band", "hash"), ["of"])
    of_roots = materialise(of_roots, "source-ranks")
    top_bands, _ = manifest(of_roots.select("tree", "rank", "n", "hash"))
    higher = paths(top_bands, None, TOP)
    # from the nodes of the tree of sources to the sources themselves
    steps = _climbed(*top_bands[0], higher[0], _path_rows(TOP), ABOVE)
    above = steps.join(of_roots.select(F.col("rank").alias("block"), "of", "band").hint("merge"), "block")
    above = materialise(above.select(F.col("of").alias("tree"), F.lit(0).cast("long").alias("block"), "level", "slot", "preimage", "band"), "source-paths")
    over = paths(bands, above)
    kind = dict(docs.dtypes)["doc_id"]
    out = _climbed(*bands[0], over[0], _proved, f"doc_id {kind}, {PROVED}")
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))

