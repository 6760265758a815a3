"""The whole run: alignments in, elements, edges, families and members out."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from famloom.config import Config
from famloom.operators.edges import partial_filter, repaired
from famloom.operators.elements import dumbbells, element_extents, greedy_elements, images, tandems, without
from famloom.operators.families import family_numbers, family_roots, members
from famloom.operators.graph import written
from famloom.operators.rounds import LARGEST, Refined, refine


@dataclass
class Result:
    #: ele_id, seq, lb, rb, img_no as first clustered.
    naive: DataFrame
    #: ele_id, stat (y in use, X gone, O tandem), seq, lb, rb, img_no, fate.
    elements: DataFrame
    #: edge_id, ele1, ele2, type, score, direction after the partial-length filter.
    edges: DataFrame
    #: fam, copies, name.
    families: DataFrame
    #: fam, ele_id, dir, seq, lb, rb, pos (place in its family).
    members: DataFrame
    #: Images of stage 2.
    images: DataFrame
    #: parent, child: what split elements became.
    children: DataFrame
    #: ele_id, bd, support: where they were split.
    cuts: DataFrame


#: Sequences of more images than LONG_SEQUENCE are cut into windows of BUCKET positions.
LONG_SEQUENCE, BUCKET = 2_000_000, 100_000


class Stages:
    """Results of stages: in a folder, where a later run finds those that are finished and goes on behind them, or else in the scratch folder.

    A folder belongs to one input and one configuration; another configuration is refused.
    """

    def __init__(self, spark: SparkSession, folder: str | None, config: Config):
        self.spark, self.folder = spark, folder.rstrip("/") if folder else None
        if self.folder:
            note = self("config", lambda: spark.createDataFrame([(repr(config),)], "config string"))
            if note.first()["config"] != repr(config):
                raise ValueError(f"{folder} holds the stages of another configuration")

    def _is_done(self, path: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def __call__(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        if not self.folder:
            return written(make(), name)
        path = f"{self.folder}/{name}"
        if not self._is_done(path):
            make().write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)


def run(msps: DataFrame, config: Config = Config(), folder: str | None = None, largest: int = LARGEST) -> Result:  # noqa: B008
    """``folder``: where stages, and the rounds of stage 2, are kept, so that a run that failed goes on where it was; ``largest``: alignments that a task of stage 2 may hold."""
    stage = Stages(msps.sparkSession, folder, config)

    def clustered() -> DataFrame:
        imgs = images(msps)
        longest = imgs.groupBy("seq").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n")).first()["n"] or 0
        return greedy_elements(imgs, config, BUCKET if longest > LONG_SEQUENCE else None)

    assigned = stage("assigned", clustered)
    extents = stage("naive", lambda: element_extents(assigned))
    bells = dumbbells(assigned).join(msps.select("msp_id", "iden", "direction", "score"), "msp_id")
    big = stage("tandems", lambda: tandems(bells, config.tandem_images, config.tandem_ratio).select("ele_id"))
    lazy: list[Refined] = []

    def refined() -> Refined:  # only if a table of it is missing
        if not lazy:
            lazy.append(refine(without(bells, big), extents.join(big, "ele_id", "left_anti"), config, stage, largest))
        return lazy[0]

    def settled() -> DataFrame:
        # New ids go on from the last given one, tandem elements included.
        out = extents.join(big, "ele_id").select("ele_id", F.lit("O").alias("stat"), "seq", "lb", "rb", "img_no", F.lit("tandem").alias("fate"))
        return refined().elements.withColumn("stat", F.when(F.col("stat") == "X", "X").otherwise("y")).unionByName(out)

    elements = stage("elements", settled)
    used = elements.where("stat = 'y'")
    edges = stage("edges", lambda: partial_filter(refined().edges, used, config.partial_ratio))
    imgs, children, cuts = (stage(name, lambda name=name: getattr(refined(), name)) for name in ("images", "children", "cuts"))
    owned = stage("owned", lambda: repaired(edges, config.mode))
    roots = stage("roots", lambda: family_roots(used, owned))
    numbers = stage("numbers", lambda: family_numbers(roots))

    def placed() -> DataFrame:
        walked = members(roots, owned)
        out = walked.join(numbers.select("root", "fam"), "root").join(used.select("ele_id", "seq", "lb", "rb"), "ele_id")
        return out.select("fam", "ele_id", "dir", "seq", "lb", "rb", "pos")

    families = numbers.select("fam", "copies", F.lit("unknown").alias("name"))
    return Result(extents, elements, edges, families, stage("members", placed) if folder else placed(), imgs, children, cuts)


def stage_counts(result: Result) -> DataFrame:
    """name, n: numbers of alignments, elements, edges and families."""
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
    return (
        count(result.naive, "naive_ele_no")
        .unionByName(count(result.elements, "redef_ele_no")).unionByName(count(result.elements.where("stat = 'y'"), "ele_no"))
        .unionByName(count(result.edges, "edge_no")).unionByName(count(result.families, "fam_no"))
    )
