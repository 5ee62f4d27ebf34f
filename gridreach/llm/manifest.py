"""Merkle dataset manifest: levels are built as parent-linked node rows, and a recursive query climbs them from each leaf.

Every language is a tree over its documents; their roots ("subroots") are the leaves of one more tree, whose root signs
the table.  Levels are built STEP at a time: a block of 2**STEP neighbouring nodes becomes one ancestor, and each node keeps a
link to that ancestor with the siblings on the way.  The climb appends these siblings and folds the leaf's hash with
them, link by link.  A join key of the climb stands for at most SPREAD leaves: a node high up is stored once
for every SPREAD leaves below it, and leaves pick a copy by their own hash, so no task gets a whole language.
Everything is DataFrame or SQL functions; only the depth of the deepest tree comes to the driver.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridreach.operators.ordered import prefix_sums
from gridreach.session import cut

#: Levels that one link spans; leaves that share one join key of the climb.
STEP, SPREAD = 8, 4096
#: Group name of the tree over the subroots; languages are named "" (null) or "=" and their value.
TOP = "*"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def _written(c: Column) -> Column:
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf_hash(**changed: Column) -> Column:
    """Hash of a row's FIELDS: each `-` if null, else its byte count, a colon and its value."""
    return F.sha2(F.concat(*[_written(changed.get(f, F.col(f))) for f in FIELDS]), 256)


def _hash(*digests: str) -> str:
    """SQL: 32-byte digest of the digests' hex texts, one behind the other; a null one adds nothing."""
    return "unhex(sha2(concat(" + ", ".join(f"lower(hex(coalesce({d}, X'')))" for d in digests) + "), 256))"


def _fold(path: str, start: str) -> str:
    return f"aggregate({path}, {start}, (a, s) -> if(s.left, {_hash('s.h', 'a')}, {_hash('a', 's.h')}))"


def _gathered(path: str, start: str) -> str:
    return f"aggregate({path}, {start}, (a, s) -> concat(a, s.h))"


def _blocks(level: DataFrame, payload: list[str]) -> DataFrame:
    """One row per block: its members in order, its STEP levels of hashes (fewer where the tree ends) and the number of leaves below.

    `left` counts the levels above the block's members.
    """
    width, last = 1 << STEP, "element_at(a, -1)"
    up = f"transform(sequence(0, (size({last}) - 1) div 2), i -> {_hash(f'{last}[2 * i]', f'get({last}, 2 * i + 1)')})"
    grown = F.expr(f"aggregate(array({', '.join(map(str, range(STEP)))}), array(transform(member, m -> m.h)), (a, j) -> if(j < left, concat(a, array({up})), a))")
    rows = level.groupBy("grp", F.floor(F.col("pos") / width).alias("block"), "left").agg(
        F.sort_array(F.collect_list(F.struct((F.col("pos") % width).cast("int").alias("i"), "h", "w", *payload))).alias("member"), F.sum("w").alias("below")
    )
    return rows.withColumn("levels", grown)


def _nodes(blocks: DataFrame, lv: int, payload: list[str]) -> DataFrame:
    """Node rows (grp, lv, pos, h, w, payload, path, left, block, below): the path holds the siblings of the built levels, empty for a lone node."""
    path = f"""transform(filter(array({", ".join(map(str, range(STEP)))}), j -> j < left), j -> named_struct(
            'h', coalesce(get(levels[j], shiftright(m.i, j) ^ 1), X''), 'left', shiftright(m.i, j) & 1 = 1))"""
    own = ", ".join(f"'{c}', m.{c}" for c in ("i", "h", "w", *payload))
    one = blocks.select("grp", "block", "left", "below", F.explode(F.expr(f"transform(member, m -> named_struct({own}, 'path', {path}))")).alias("m"))
    return one.select("grp", F.lit(lv).alias("lv"), (F.col("block") * (1 << STEP) + F.col("m.i")).alias("pos"), *[F.col(f"m.{c}").alias(c) for c in ("h", "w", *payload, "path")], "left", "block", "below")


def _depth(n: Column) -> Column:
    """Levels above the leaves of a tree of n leaves."""
    return F.when(n <= 1, 0).otherwise(F.length(F.bin(n - 1)))


def _tree(level: DataFrame, payload: list[str]) -> tuple[list[DataFrame], DataFrame]:
    """Node rows of every STEP levels of all trees, linked upwards, and each tree's root as (grp, h, w).

    level: grp, pos, h, w, left (levels of its tree above), payload.  The links of a tree's last nodes have no target.
    """
    tables, roots, lv = [], [], 0
    deepest = level.agg(F.max("left")).first()[0]
    while deepest is not None:
        blocks = cut(_blocks(level, payload))
        nodes = _nodes(blocks, lv, payload)
        on = F.col("left") > STEP
        link = F.when(on, F.struct("grp", F.lit(lv + 1).alias("lv"), F.col("block").alias("pos"), F.col("below").alias("w")))
        tables.append(nodes.select("grp", "lv", "pos", "h", "w", *payload, "path", link.alias("to")))
        top = blocks.select("grp", F.col("block").alias("pos"), F.element_at(F.element_at("levels", -1), 1).alias("h"), F.col("below").alias("w"), (F.col("left") - STEP).alias("left"))
        roots.append(top.where("left <= 0").select("grp", "h", "w"))
        level, payload, lv, deepest = top.where("left > 0"), [], lv + 1, deepest - STEP if deepest > STEP else None
    return tables, reduce(DataFrame.unionByName, roots) if roots else level.select("grp", "h", "w")


def _copied(nodes: DataFrame) -> DataFrame:
    """Nodes as targets of links, once for every SPREAD leaves below."""
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("w") - 1) / SPREAD)))
    return nodes.select("grp", "lv", "pos", "path", "to", copies.alias("copy"))


def prove(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row.

    A leaf hashes the row's FIELDS.  Leaves of a language stand by doc_id (null first), then by hash; pairs become nodes, a last single
    node alone, up to the subroot; subroots by language (null first, bytes ascending) likewise give the root.  `folded_root`
    starts from the leaf with n_chars one larger where 7 divides crc32(doc_id): a null n_chars, or a null id, is not tampered with.
    Repeated rows are leaves of their own; a single row is its own root with an empty proof.  Extra columns are ignored,
    an empty table gives an empty result.
    """
    spark = docs.sparkSession
    more = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False)) & F.col("n_chars").isNotNull()
    leaf, forged = F.unhex(leaf_hash()), F.unhex(leaf_hash(n_chars=F.col("n_chars").cast("decimal(20,0)") + 1))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")).alias("grp"), leaf.alias("h"), F.when(more, forged).alias("forged"), F.lit(1).cast("long").alias("w"))
    ranked = prefix_sums(rows, ["grp"], [F.col("doc_id").asc_nulls_first(), "h"], {"at": "w"})
    placed = cut(ranked.select("grp", (F.col("at_cum") - 1).alias("pos"), "h", "w", _depth(F.col("at_total")).alias("left"), "doc_id", "forged"))
    own, subroots = _tree(placed, ["doc_id", "forged"])
    named = prefix_sums(subroots.withColumn("one", F.lit(1).cast("long")).withColumn("_top", F.lit(TOP)), ["_top"], ["grp"], {"at": "one"})
    named = cut(named.select(F.col("_top").alias("grp"), (F.col("at_cum") - 1).alias("pos"), "h", "w", _depth(F.col("at_total")).alias("left"), F.col("grp").alias("lang")))
    above, root = _tree(named, ["lang"])

    seat = named.select(F.col("lang").alias("grp"), F.struct("grp", F.lit(0).alias("lv"), "pos", "w").alias("seat"))
    linked = [t.join(seat, "grp").withColumn("to", F.coalesce("to", "seat")).drop("seat") for t in own]
    linked += [t.drop("lang") for t in above]
    if not linked:
        return spark.createDataFrame([], "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    start, targets = linked[0], cut(reduce(DataFrame.unionByName, [_copied(t) for t in linked[1:]]))
    view = f"manifest_{uuid.uuid4().hex}"
    start.createOrReplaceTempView(f"{view}_leaf")
    targets.createOrReplaceTempView(f"{view}_node")
    limit = spark.conf.get("spark.sql.cteRecursionRowLimit")
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")  # every leaf climbs
    try:
        climbed = cut(spark.sql(f"""
            WITH RECURSIVE climb AS (
              SELECT doc_id, h AS leaf, grp, {_gathered("path", "X''")} AS proof, {_fold("path", "coalesce(forged, h)")} AS folded, to FROM {view}_leaf
              UNION ALL
              SELECT c.doc_id, c.leaf, c.grp, {_gathered("n.path", "c.proof")}, {_fold("n.path", "c.folded")}, n.to FROM climb c JOIN {view}_node n
              ON n.grp = c.to.grp AND n.lv = c.to.lv AND n.pos = c.to.pos AND n.copy = pmod(xxhash64(c.doc_id, c.leaf), (c.to.w - 1) div {SPREAD} + 1))
            SELECT doc_id, lower(hex(leaf)) AS leaf, grp, sha2(lower(hex(proof)), 256) AS proof_sha256, lower(hex(folded)) AS folded FROM climb WHERE to IS NULL"""))
    finally:
        spark.conf.set("spark.sql.cteRecursionRowLimit", limit)
        spark.catalog.dropTempView(f"{view}_leaf")
        spark.catalog.dropTempView(f"{view}_node")
    text = F.lower(F.hex("h"))
    top = root.select(text.alias("root")).scalar()
    out = climbed.join(subroots.select("grp", text.alias("subroot")), "grp").withColumn("root", top)
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", F.col("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"))


def prove_sql() -> str:
    """The same for DuckDB, level by level."""
    field = lambda c: f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"
    leaf = lambda n: "sha256(" + " || ".join(field(n if f == "n_chars" else f) for f in FIELDS) + ")"
    crc = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
             lambda a, x: list_reduce(list_prepend(xor(a, x), range(8)), lambda b, _: xor(b >> 1, (b & 1) * 3988292384::BIGINT))), 4294967295::BIGINT)"""
    up = lambda name, anchor: f"""{name} AS ({anchor}
      UNION ALL SELECT g, lv + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2 FROM {name} WHERE n > 1 GROUP BY g, lv, pos // 2, n)"""  # noqa: E731
    climb = lambda name, levels, anchor: f"""{name} AS ({anchor}
      UNION ALL SELECT c.r, c.g, c.lv + 1, c.pos // 2, c.proof || coalesce(s.h, ''), sha256(CASE WHEN c.pos % 2 = 1 THEN s.h || c.f ELSE c.f || coalesce(s.h, '') END)
      FROM {name} c JOIN {levels} me ON me.g = c.g AND me.lv = c.lv AND me.pos = c.pos AND me.n > 1
      LEFT JOIN {levels} s ON s.g = c.g AND s.lv = c.lv AND s.pos = xor(c.pos, 1))"""  # noqa: E731
    return f"""
WITH RECURSIVE leaf AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS pos, row_number() OVER () AS r FROM (
    SELECT doc_id, coalesce('=' || lang, '') AS g, {leaf("n_chars")} AS h,
           CASE WHEN {crc} % 7 = 0 AND n_chars IS NOT NULL THEN {leaf("(n_chars + 1)")} END AS forged FROM documents)),
{up("low", "SELECT g, 0 AS lv, pos, h, count(*) OVER (PARTITION BY g) AS n FROM leaf")},
sub AS MATERIALIZED (SELECT g AS lang, h, row_number() OVER (ORDER BY g) - 1 AS pos FROM low WHERE n = 1),
{up("high", "SELECT '*' AS g, 0 AS lv, pos, h, count(*) OVER () AS n FROM sub")},
{climb("inner_climb", "low", "SELECT r, g, 0 AS lv, pos, '' AS proof, coalesce(forged, h) AS f FROM leaf")},
{climb("outer_climb", "high", "SELECT i.r, '*' AS g, 0 AS lv, sub.pos, i.proof, i.f FROM inner_climb i JOIN low ON low.g = i.g AND low.lv = i.lv AND low.pos = i.pos AND low.n = 1 JOIN sub ON sub.lang = i.g")}
SELECT leaf.doc_id, leaf.h AS leaf, sub.h AS subroot, top.h AS root, sha256(o.proof) AS proof_sha256, o.f AS folded_root, o.f = top.h AS verified
FROM leaf JOIN sub ON sub.lang = leaf.g JOIN outer_climb o ON o.r = leaf.r JOIN high top ON top.g = o.g AND top.lv = o.lv AND top.pos = o.pos AND top.n = 1
"""
