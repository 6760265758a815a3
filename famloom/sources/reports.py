"""Text reports, graph export and comparison of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

ELES_HEADER, FAMILIES_HEADER = "#  fam    ele   dir  sequence    start     end", "#  fam  copies  name"

#: Tables of a run.
TABLES = ("naive", "elements", "edges", "families", "members", "images", "children", "cuts")


def eles_lines(members: DataFrame) -> DataFrame:
    """fam, pos and the fixed-width line of each member."""
    return members.select("fam", "pos", F.format_string("%6d %6d %2d %10s %8d %8d ", "fam", "ele_id", "dir", F.col("seq").cast("string"), "lb", "rb").alias("value"))


def family_lines(families: DataFrame) -> DataFrame:
    return families.select("fam", F.format_string("%d %d %s ", "fam", "copies", "name").alias("value"))


def status_lines(elements: DataFrame) -> DataFrame:
    """``ele stat updated``: only elements in use were updated."""
    return elements.select("ele_id", F.format_string("%d %s %d", "ele_id", "stat", F.when(F.col("stat") == "y", 1).otherwise(0)).alias("value"))


def write_reports(result, path: str) -> None:
    """eles, families, redef_stat, naive_eles, edges, combo, obsolete, unproc and elements, each a folder of text in order."""
    eles_lines(result.members).sort("fam", "pos").select("value").write.text(f"{path}/eles")
    family_lines(result.families).sort("fam").select("value").write.text(f"{path}/families")
    status_lines(result.elements).sort("ele_id").select("value").write.text(f"{path}/redef_stat")
    result.naive.sort("ele_id").select(F.concat_ws(" ", "ele_id", "seq", "lb", "rb").alias("value")).write.text(f"{path}/naive_eles")
    edge_lines(result.edges).sort("edge_id").select("value").write.text(f"{path}/edges")
    for reason, name in (("combo", "combo"), ("obsolete", "obsolete"), ("tandem", "unproc")):
        lineage_lines(result).where(F.col("reason") == reason).sort("ele_id").select("value").write.text(f"{path}/{name}")
    element_text(result).sort("ele_id", "k", "a", "b").select("value").write.text(f"{path}/elements")


def lineage(result) -> DataFrame:
    """Elements that are gone and why (combo: split, obsolete: no images, tandem), with their children and the boundaries they were split at."""
    gone = result.elements.where("fate is not null").select("ele_id", F.col("fate").alias("reason"), "seq", "lb", "rb")
    young = result.children.groupBy(F.col("parent").alias("ele_id")).agg(F.sort_array(F.collect_list("child")).alias("children"))
    cuts = result.cuts.groupBy("ele_id").agg(F.sort_array(F.collect_list(F.struct("bd", "support"))).alias("cuts"))
    return gone.join(young, "ele_id", "left").join(cuts, "ele_id", "left")


def lineage_lines(result) -> DataFrame:
    """ele_id, reason and a line for each element that is gone: extent, children, boundaries as position:support."""
    words = lambda a: F.coalesce(F.array_join(a, " "), F.lit(""))
    cuts = F.transform("cuts", lambda c: F.concat_ws(":", c["bd"], c["support"]))
    return lineage(result).select("ele_id", "reason", F.concat_ws(" ", "ele_id", "seq", "lb", "rb", F.lit("->"), words(F.transform("children", lambda c: c.cast("string"))), F.lit("|"), words(cuts)).alias("value"))


def checked_edges(edges: DataFrame) -> DataFrame:
    """``edges``; an edge of an element with itself, or of type c, fails when it is read."""
    wrong = (F.col("ele1") == F.col("ele2")) | (F.col("type") == "c")
    return edges.withColumn("type", F.when(wrong, F.raise_error(F.concat(F.lit("illegal edge "), F.col("edge_id").cast("string"))).cast("string")).otherwise(F.col("type")))


def edge_lines(edges: DataFrame) -> DataFrame:
    """edge_id and the line of each edge; illegal edges fail."""
    return checked_edges(edges).select("edge_id", F.concat_ws(" ", F.lit("edge"), "edge_id", "type", "direction", "score", "ele1", "ele2").alias("value"))


def element_text(result) -> DataFrame:
    """Elements as keyword records: lines of ele_id in order of k, a, b (extent, counts, images, edges, boundaries, children)."""
    rows = lambda df, k, a, b, *words: df.select(F.col("ele_id"), F.lit(k).alias("k"), F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b"), F.concat_ws(" ", *words).alias("value"))
    own = F.explode(F.array("ele1", "ele2")).alias("ele_id")
    edges = checked_edges(result.edges).select(own, "edge_id", "type", "direction", "score", "ele1", "ele2")
    counts = edges.groupBy("ele_id").agg(F.count(F.lit(1)).alias("edge_no"))
    heads = result.elements.join(counts, "ele_id", "left").withColumn("edge_no", F.coalesce("edge_no", F.lit(0)))
    return (
        rows(heads, 0, "ele_id", "ele_id", F.lit("ele"), "ele_id", "stat")
        .unionByName(rows(heads, 1, "lb", "rb", F.lit("frag"), "seq", "lb", "rb"))
        .unionByName(rows(heads, 2, "img_no", "edge_no", F.lit("img_no"), "img_no", F.lit("edge_no"), "edge_no"))
        .unionByName(rows(result.images, 3, "msp_id", "side", F.lit("msp"), "msp_id", "side", "stat", "score", "iden", "direction", "lb", "rb"))
        .unionByName(rows(edges, 4, "edge_id", "edge_id", F.lit("edge"), "edge_id", "type", "direction", "score", "ele1", "ele2"))
        .unionByName(rows(result.cuts, 5, "bd", "support", F.lit("tbd"), "bd", "support"))
        .unionByName(rows(result.children.withColumnRenamed("parent", "ele_id"), 6, "child", "child", F.lit("redef"), "child"))
    )


def show_elements(result, *ids: int) -> str:
    """The records of a few elements, to look at."""
    return "\n".join(r["value"] for r in element_text(result).where(F.col("ele_id").isin(*ids)).sort("ele_id", "k", "a", "b").collect())


def snapshot(result, path: str) -> None:
    """All tables of a run, to start again from."""
    for name in TABLES:
        getattr(result, name).write.parquet(f"{path}/{name}")


def restored(spark: SparkSession, path: str):
    from famloom.plans.pipeline import Result

    return Result(*(spark.read.parquet(f"{path}/{name}") for name in TABLES))


def gml_edges(edges: DataFrame) -> DataFrame:
    """One line for each pair of elements, the smaller first, of its first edge's type."""
    pairs = edges.groupBy(F.least("ele1", "ele2").alias("a"), F.greatest("ele1", "ele2").alias("b")).agg(F.min_by("type", "edge_id").alias("type"))
    return pairs.select("a", "b", F.concat(F.lit("edge [ source "), "a", F.lit(" target "), "b", F.lit(' label "'), "type", F.lit('" ]')).alias("value"))


def gml_nodes(elements: DataFrame) -> DataFrame:
    return elements.select("ele_id", F.concat(F.lit("node [ id "), "ele_id", F.lit(' label "'), "ele_id", F.lit('" ]')).alias("value"))


def write_gml(elements: DataFrame, edges: DataFrame, path: str) -> None:
    """An undirected graph; parts are to be put together in order of their names."""
    spark = elements.sparkSession
    head, tail = spark.createDataFrame([(0, 0, 0, "graph [ directed 0")], "k int, a long, b long, value string"), spark.createDataFrame([(3, 0, 0, "]")], "k int, a long, b long, value string")
    nodes = gml_nodes(elements).select(F.lit(1).alias("k"), F.col("ele_id").alias("a"), F.lit(0).cast("long").alias("b"), "value")
    lines = gml_edges(edges).select(F.lit(2).alias("k"), "a", "b", "value")
    head.unionByName(nodes).unionByName(lines).unionByName(tail).sort("k", "a", "b").select("value").write.text(path)


def family_report(members: DataFrame, images: DataFrame, partner_of: DataFrame) -> DataFrame:
    """For each element of a family: where its images begin and end, how many, the longest, and how many have a partner in a family.

    ``images``: img_id, ele_id, lb, rb; ``partner_of``: img_id, p_ele.
    """
    return family_images(members, images, partner_of).groupBy("fam", "ele_id").agg(
        F.min("lb").alias("start"), F.max("rb").alias("end"), F.max(F.col("rb") - F.col("lb")).alias("longest"), F.count(F.lit(1)).alias("n_images"),
        F.count("p_fam").alias("n_paired"), F.sum((F.col("p_fam") == F.col("fam")).cast("long")).alias("n_inside"),
    )


def family_images(members: DataFrame, images: DataFrame, partner_of: DataFrame) -> DataFrame:
    """Each image of a family's elements: fam, ele_id, img_id, lb, rb, whether its partner is in a family (paired), and in which (p_fam)."""
    fams = members.select("ele_id", "fam")
    other = fams.select(F.col("ele_id").alias("p_ele"), F.col("fam").alias("p_fam"))
    rows = images.join(fams, "ele_id").join(partner_of, "img_id").join(other, "p_ele", "left")
    return rows.select("fam", "ele_id", "img_id", "lb", "rb", F.col("p_fam").isNotNull().alias("paired"), "p_ele", "p_fam")


def run_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of either run that the other has not, repeats counted, with ``side``."""
    return counted_diff(left.withColumn("__by", F.lit(1)).union(right.withColumn("__by", F.lit(-1))))


def counted_diff(rows: DataFrame) -> DataFrame:
    """``run_diff`` of two runs in one table, whose ``__by`` is 1 for the left and -1 for the right one: one aggregation nets them."""
    names = [c for c in rows.columns if c != "__by"]
    net = rows.groupBy(*names).agg(F.sum("__by").cast("int").alias("__by")).where("__by != 0")
    return net.select(*names, F.explode(F.array_repeat(F.when(F.col("__by") > 0, "left").otherwise("right"), F.abs("__by"))).alias("side"))


def compare_runs(spark: SparkSession, left: dict[str, DataFrame], right: dict[str, DataFrame]) -> DataFrame:
    """name, verdict (MATCH, DIFF, MISSING) for tables of lines (``value``), trailing blanks aside."""
    out = []
    for name in sorted(left.keys() | right.keys()):
        if name not in left or name not in right:
            out.append((name, "MISSING"))
            continue
        a, b = (x.select(F.rtrim("value").alias("value")) for x in (left[name], right[name]))
        out.append((name, "DIFF" if run_diff(a, b).limit(1).count() else "MATCH"))
    return spark.createDataFrame(out, "name string, verdict string")


def dataset_key(spark: SparkSession, path: str) -> str:
    """First 12 hex digits of the md5 of a file (or of a folder's files in order of their names), by which golden sets are named.

    The bytes stream through the digest in the JVM; none are kept.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(conf)
    digest = jvm.java.security.MessageDigest.getInstance("MD5")
    files = [at] if fs.getFileStatus(at).isFile() else sorted((s.getPath() for s in fs.listStatus(at) if s.isFile()), key=lambda p: p.getName())
    for f in files:
        if not f.getName().startswith(("_", ".")):
            source = jvm.java.security.DigestInputStream(fs.open(f), digest)
            try:
                source.transferTo(jvm.java.io.OutputStream.nullOutputStream())
            finally:
                source.close()
    return bytes(digest.digest()).hex()[:12]
