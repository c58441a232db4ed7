"""WARC fixity: Merkle trees over records and ordered offset ranges.

A page is a WARC/1.1 record; records follow each other in order of id. A leaf is
the SHA-256 of a record's bytes. A range holds the records of SPAN consecutive
ids, which are consecutive offsets of the file, and hashes each record's offset
within the range, its length and its leaf; FANOUT ranges make a node, and so on
up to the root. Offsets count from the range's own start, so a lost record spoils
its own branch and no other.

Two replicas are compared from the root down. Only children of nodes that differ
are looked at, so the work past the trees follows the damage, not the archive:
a record is compared only in a range that differs.

Every level is a grouped aggregate over a table FANOUT times smaller than the one
below, and no group has more than FANOUT nodes or the records of SPAN ids.

Defined results. Null url and html are empty. Rows without an id take no part.
Rows that repeat an id are records of their own, in order of their hashes. An
empty archive has no root; against one, every record is missing or extra. Other
columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .linking import saved

SPAN = 64
FANOUT = 16
DATE = "2024-01-01T00:00:00Z"


def record(page_id: str = "page_id", url: str = "url", html: str = "html", date: str = DATE) -> Column:
    """A page as the text of a WARC resource record."""
    body = F.coalesce(F.col(html).cast("string"), F.lit(""))
    head = [
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:x-page:"),
        F.col(page_id).cast("string"),
        F.lit(f">\r\nWARC-Date: {date}\r\nWARC-Target-URI: "),
        F.coalesce(F.col(url).cast("string"), F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"),
    ]
    return F.concat(*head, body, F.lit("\r\n\r\n"))


def leaves(pages: DataFrame) -> DataFrame:
    """id, nth (among the records of the id), length and sha256 of each record."""
    rows = pages.where("page_id is not null").select(F.col("page_id").cast("long").alias("id"), record().alias("r")).select("id", F.octet_length("r").cast("long").alias("length"), F.sha2("r", 256).alias("sha256"))
    return rows


class Tree:
    """Written tables of one replica: ranges with their records, and the levels above."""

    def __init__(self, pages: DataFrame):
        rows = leaves(pages).groupBy(F.expr(f"cast(floor(id / {SPAN}.0) as long)").alias("node")).agg(F.array_sort(F.collect_list(F.struct("id", "sha256", "length"))).alias("records"))
        start = F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<struct<id:long,nth:int,inner:long,length:long,sha256:string>>)").alias("out"))

        def place(a: Column, x: Column) -> Column:
            last = F.try_element_at(a["out"], F.lit(-1))
            nth = F.when(last["id"] == x["id"], last["nth"] + 1).otherwise(0)
            one = F.struct(x["id"].alias("id"), nth.alias("nth"), a["at"].alias("inner"), x["length"].alias("length"), x["sha256"].alias("sha256"))
            return F.struct((a["at"] + x["length"]).alias("at"), F.concat(a["out"], F.array(one)).alias("out"))

        placed = rows.select("node", F.aggregate("records", start, place).alias("p"))
        told = F.transform("records", lambda x: F.concat_ws(":", x["inner"].cast("string"), x["length"].cast("string"), x["sha256"]))
        self.ranges = saved(placed.select("node", F.col("p.at").alias("bytes"), F.col("p.out").alias("records")).withColumn("hash", F.sha2(F.array_join(told, ","), 256)))
        self.levels = [self.ranges.select("node", "bytes", "hash")]

    def grow(self, height: int) -> None:
        """Levels up to the given height, whatever the archive's own size."""
        while len(self.levels) <= height:
            below = self.levels[-1].select(F.expr(f"cast(floor(node / {FANOUT}.0) as long)").alias("up"), "node", "bytes", "hash")
            told = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node", "hash"))), lambda x: F.concat_ws(":", x["node"].cast("string"), x["hash"])), ",")
            self.levels.append(saved(below.groupBy("up").agg(F.sum("bytes").alias("bytes"), F.sha2(told, 256).alias("hash")).withColumnRenamed("up", "node")))

    def offsets(self) -> DataFrame:
        """node, base: the file offset of each range, from the levels' sums and no global order."""
        base = None
        for level in reversed(self.levels):
            top = base is None  # one or two nodes, -1 and 0: they follow each other
            rows = level.select("node", "bytes", F.expr("0L" if top else f"cast(floor(node / {FANOUT}.0) as long)").alias("up"))
            within = Window.partitionBy("up").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
            rows = rows.withColumn("before", F.coalesce(F.sum("bytes").over(within), F.lit(0)))
            base = rows.select("node", F.col("before").alias("base")) if top else rows.join(base.select(F.col("node").alias("up"), F.col("base").alias("above")), "up").select("node", (F.col("above") + F.col("before")).alias("base"))
        return base


def _height(*trees: Tree) -> int:
    """Levels needed until all nodes are one; negative and positive ids meet under two top nodes, -1 and 0."""
    ends = reduce(lambda a, b: a.unionByName(b), [t.ranges.select("node") for t in trees]).agg(F.min("node"), F.max("node")).first()
    low, high = ends[0] or 0, ends[1] or 0
    height = 0
    while low < -1 or high > 0:
        low, high, height = low // FANOUT, high // FANOUT, height + 1
    return height


def differences(left: Tree, right: Tree) -> DataFrame:
    """id, nth, state of records that differ: changed, missing (in right) or extra (in right)."""
    height = _height(left, right)
    left.grow(height)
    right.grow(height)

    def unequal(a: DataFrame, b: DataFrame) -> DataFrame:
        both = a.select("node", F.col("hash").alias("x")).join(b.select("node", F.col("hash").alias("y")), "node", "full_outer")
        return both.where(~F.col("x").eqNullSafe(F.col("y"))).select("node")

    bad = unequal(left.levels[height], right.levels[height])
    for k in range(height - 1, -1, -1):
        above = saved(bad.withColumnRenamed("node", "up"))
        under = [t.levels[k].withColumn("up", F.expr(f"cast(floor(node / {FANOUT}.0) as long)")).join(above, "up", "left_semi") for t in (left, right)]
        bad = unequal(*under)
    bad = saved(bad)
    x, y = (t.ranges.join(bad, "node", "left_semi").select(F.explode("records").alias("r")).select("r.id", "r.nth", F.struct("r.length", "r.sha256").alias(name)) for t, name in ((left, "x"), (right, "y")))
    both = x.join(y, ["id", "nth"], "full_outer").where(~F.col("x").eqNullSafe(F.col("y")))
    return both.select("id", "nth", F.when(F.col("y").isNull(), "missing").when(F.col("x").isNull(), "extra").otherwise("changed").alias("state"))


def audit(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """page_id, warc_offset, length, sha256 and state (same, changed, missing, extra) of every record; extra ones have no offset."""
    left, right = Tree(primary), Tree(replica)
    found = saved(differences(left, right))
    records = left.ranges.join(left.offsets(), "node").select("base", F.explode("records").alias("r"))
    rows = records.select("r.id", "r.nth", (F.col("base") + F.col("r.inner")).alias("warc_offset"), "r.length", "r.sha256")
    known = rows.join(found.where("state <> 'extra'"), ["id", "nth"], "left").select(F.col("id").alias("page_id"), "warc_offset", "length", "sha256", F.coalesce("state", F.lit("same")).alias("state"))
    null = lambda kind: F.lit(None).cast(kind)
    return known.unionByName(found.where("state = 'extra'").select(F.col("id").alias("page_id"), null("long").alias("warc_offset"), null("long").alias("length"), null("string").alias("sha256"), "state"))


def op5_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages against a replica with damage by rule: a byte changed where page_id % 97 = 13, a record lost where page_id % 101 = 50."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    hurt = F.when(F.col("page_id") % 97 == 13, F.concat(F.lit("#"), F.substr(F.col("html"), F.lit(2)))).otherwise(F.col("html"))
    replica = pages.where("page_id % 101 <> 50").withColumn("html", hurt)
    return audit(pages, replica)


SQL = f"""
WITH r AS (SELECT page_id, html, url, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:x-page:' || page_id || '>' || chr(13) || chr(10)
             || 'WARC-Date: {DATE}' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10)
             || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS rec FROM pages)
SELECT page_id, CAST(coalesce(sum(strlen(rec)) OVER (ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS warc_offset,
       CAST(strlen(rec) AS BIGINT) AS length, sha256(rec) AS sha256,
       CASE WHEN page_id % 101 = 50 THEN 'missing' WHEN page_id % 97 = 13 AND substr(html, 1, 1) <> '#' THEN 'changed' ELSE 'same' END AS state
FROM r
"""
