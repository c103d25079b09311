"""Merkle manifest: documents as leaves of a content-addressed tree, proofs by descent from the root, tampering found by folding back."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnloom.llm.scratch import drop, write

#: Children of a node; a rank's digits in this base are its way from the root.
FAN = 16
BITS = 4
#: What a leaf is made of, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass
class Manifest:
    """Tables in the shared folder; `drop` removes them."""

    #: (tree, rank, size, digest, and what `leaves` carried): every leaf with its rank in its source's tree of `size` leaves.
    leaves: DataFrame
    #: For each level above the leaves, (digest, children): one record for each digest, whatever number of places it has.
    records: list[DataFrame]
    #: (tree, top_rank, levels, subroot): each source's tree, its place among the sources and its height.
    trees: DataFrame
    #: The same for the tree over the subroots.
    top_records: list[DataFrame]
    #: None for an empty table.
    root: str | None
    folders: list[str]

    def drop(self, spark: SparkSession) -> None:
        drop(spark, *self.folders)


def digest(*parts: Column) -> Column:
    """sha256 of the parts one behind the other, in lower-case hex."""
    return F.sha2(F.concat(*parts), 256)


def encoded(value: Column) -> Column:
    """`-` for a null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(text: Column | None = None) -> Column:
    """The leaf of a row of documents, with another text if one is given."""
    return digest(*(encoded(text if name == "text" and text is not None else F.col(name)) for name in FIELDS))


def tree_of(source: Column) -> Column:
    """A name for each source that has no null and sorts bytewise: a null source comes first."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit(""))


def ranked(rows: DataFrame, by: list[str], name: str) -> tuple[DataFrame, list[str]]:
    """rows with `rank` (from 0, in the order of `by` inside the tree) and `size` of their tree; rows equal in `by` stand in any order.

    Rows are sorted by ranges, so that a large tree lies in many partitions; what is summed along a tree is one row for
    each partition it lies in, not one a row.
    """
    tie = F.monotonically_increasing_id()
    spread = rows.withColumn("_tie", tie).repartitionByRange("tree", *by, "_tie").sortWithinPartitions("tree", *by, "_tie").drop("_tie")
    sorted_rows, folder = write(spread.withColumn("_at", F.monotonically_increasing_id()), name)
    sorted_rows = sorted_rows.withColumn("_part", F.shiftright("_at", 33))
    runs = sorted_rows.groupBy("tree", "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    along = Window.partitionBy("tree")
    before = F.sum("_n").over(along.orderBy("_part")) - F.col("_n")
    runs = runs.select("tree", "_part", (F.col("_first") - before).alias("_zero"), F.sum("_n").over(along).alias("size"))
    placed = sorted_rows.join(runs, ["tree", "_part"])
    return placed.withColumn("rank", F.col("_at") - F.col("_zero")).drop("_at", "_part", "_zero"), [folder]


def grown(nodes: DataFrame, levels: int, name: str) -> tuple[list[DataFrame], DataFrame, list[str]]:
    """Records of each level, the trees' roots (tree, levels, digest), and the folders, from nodes (tree, rank, size, digest)."""
    nodes = nodes.select("tree", "rank", "size", "digest")
    records, folders = [], []
    roots = nodes.filter("size = 1").select("tree", F.lit(0).alias("levels"), "digest")
    for level in range(1, levels + 1):
        runs = nodes.filter("size > 1").groupBy("tree", F.shiftright("rank", BITS).alias("rank"), F.shiftright(F.col("size") + (FAN - 1), BITS).alias("size"))
        children = runs.agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "digest"))), lambda c: c["digest"]).alias("children"))  # FAN at most
        nodes, folder = write(children.withColumn("digest", digest(F.array_join("children", ""))), f"{name}-{level}")
        records.append(nodes.select("digest", "children").dropDuplicates(["digest"]))
        roots = roots.unionByName(nodes.filter("size = 1").select("tree", F.lit(level).alias("levels"), "digest"))
        folders.append(folder)
    return records, roots, folders


def height(nodes: DataFrame) -> int:
    """Levels above the leaves of the largest tree."""
    size, levels = nodes.agg(F.max("size")).first()[0] or 0, 0
    while size > 1:
        size, levels = -(-size // FAN), levels + 1
    return levels


def build(docs: DataFrame, **more: Column) -> Manifest:
    """The manifest of all rows of docs; `more` columns travel with the leaves, under names other than those of `Manifest`.

    Each source is a tree of its own (rows without source are one, and it is the first). Leaves ascend by doc_id, null first;
    rows of one id ascend by their leaf, so that rows equal in all fields may stand in any order without changing a digest.
    Fields are taken as text; other columns of docs, whatever their names, have no part in it.
    """
    own = docs.select(tree_of(F.col("source")).alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), leaf_digest().alias("digest"), *(c.alias(n) for n, c in more.items()))
    leaves, first = write(own, "leaves")
    placed, folders = ranked(leaves, ["doc_id", "digest"], "ranked-leaves")
    records, roots, more_folders = grown(placed, height(placed), "records")
    tops, top_folders = ranked(roots.select(F.lit("").alias("tree"), F.col("tree").alias("of"), "levels", "digest"), ["of"], "ranked-roots")
    top_records, root, top_record_folders = grown(tops, height(tops), "top-records")
    found = root.select("digest").first()
    trees = tops.select(F.col("of").alias("tree"), F.col("rank").alias("top_rank"), "levels", F.col("digest").alias("subroot"))
    return Manifest(placed, records, trees, top_records, found[0] if found else None, [first, *folders, *more_folders, *top_folders, *top_record_folders])


def _step(frontier: DataFrame, records: DataFrame, wanted: DataFrame) -> DataFrame:
    """One level down: of each node of the frontier the children that are wanted, their siblings put on the path."""
    opened = frontier.join(records, "digest").drop("digest").withColumnRenamed("rank", "_parent")
    down = wanted.withColumn("_parent", F.shiftright("rank", BITS)).join(opened, ["tree", "_parent"])
    digit = F.col("rank").bitwiseAND(F.lit(FAN - 1)).cast("int")
    left = F.array_join(F.slice("children", F.lit(1), digit), "")
    right = F.array_join(F.slice("children", digit + 2, F.lit(FAN)), "")
    path = F.concat("path", F.array(F.struct(left.alias("left"), right.alias("right"))))
    return down.withColumns({"digest": F.get("children", digit), "path": path}).drop("children", "_parent").filter("digest IS NOT NULL")


NO_PATH = "cast(array() as array<struct<left: string, right: string>>)"


def prove(manifest: Manifest, requests: DataFrame) -> DataFrame:
    """requests (tree, rank, any others but `Manifest`'s) with `digest` of the leaf, `subroot` and `path`: from the leaf up to the root, each level's siblings left and right of it.

    Requests descend together from the root: a level opens each node on their ways once, by its digest, and their ranks'
    digits tell which children to take. So paths are as many as the nodes of a level, and only the last level has one a request.
    A request for a rank that a tree doesn't have gives no row.
    """
    spark = requests.sparkSession
    trees = manifest.trees.join(requests.select("tree").distinct(), "tree")
    if manifest.root is None:
        return requests.join(trees.select("tree", "subroot"), "tree").withColumns({"digest": F.col("subroot"), "path": F.expr(NO_PATH)})
    tops = trees.select(F.lit("").alias("tree"), F.col("top_rank").alias("rank"))
    # A row, not literals: joins with literals would become joins without a key.
    frontier = spark.createDataFrame([("", 0, manifest.root)], "tree string, rank long, digest string").withColumn("path", F.expr(NO_PATH))
    for level in reversed(range(len(manifest.top_records))):
        # Written level by level: a level is a small table, and one plan of all of them would fill the driver.
        frontier, _ = write(_step(frontier, manifest.top_records[level], tops.select("tree", F.shiftright("rank", BITS * level).alias("rank")).distinct()), "frontier")
    entered = frontier.select(F.col("rank").alias("top_rank"), "digest", "path").join(trees, "top_rank")
    entered = entered.select("tree", F.lit(0).cast("long").alias("rank"), "digest", "path", "subroot", "levels")
    at = lambda k: entered.filter(F.col("levels") == k).drop("levels")
    height = len(manifest.records)
    frontier = at(height)
    for level in reversed(range(1, height)):
        wanted = requests.select("tree", F.shiftright("rank", BITS * level).alias("rank")).distinct()
        frontier, _ = write(_step(frontier, manifest.records[level], wanted).unionByName(at(level)), "frontier")
    lone = requests.join(at(0).drop("rank"), "tree").filter("rank = 0")
    found = _step(frontier, manifest.records[0], requests).unionByName(lone) if height else lone
    return found.withColumn("path", F.reverse("path"))


def proof_digest(path: str = "path") -> Column:
    """sha256 over the siblings from the leaf's level up to the root's, left to right."""
    return digest(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""))


def folded(leaf: Column, path: str = "path") -> Column:
    """The root that a leaf and its siblings make."""
    return F.aggregate(path, leaf, lambda acc, s: digest(s["left"], acc, s["right"]))


def verify(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row, against a copy in which some rows are altered.

    Where 5 divides the crc32 of the decimal doc_id, the row's text has its A-Z lowered before its leaf is folded; a row
    without text or id stays as it is. Such a row is verified only if its text has no such letter. Empty tables give no row.
    """
    hit = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    lowered = F.translate(F.col("text").cast("string"), UPPER, LOWER)
    manifest = build(docs, altered=F.when(F.coalesce(hit, F.lit(False)), leaf_digest(lowered)))
    requests = manifest.leaves.select("tree", "rank", "doc_id", "altered")
    found = prove(manifest, requests)
    out = found.select(
        "doc_id", F.col("digest").alias("leaf"), "subroot", F.lit(manifest.root).cast("string").alias("root"), proof_digest().alias("proof_sha256"),
        folded(F.coalesce("altered", "digest")).alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
