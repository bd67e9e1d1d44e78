"""Incremental detection: new elements against all that came before, with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.broadphase import broad_phase, scope
from ..operators.geometry import AXES
from ..plans.detect import clashes_of, with_identity
from ..schema import Rules
from ..sources.payload import parse_elements


#: Stored elements lie in folders by place: the level of their size and the cell of their low corner. Cells of level 0 are this wide (metres).
PLACE_METRES, PLACE_LEVELS = 64.0, 10
#: A batch that is near more places than this is read by the box around it alone.
MOST_PLACES = 20_000


def with_place(elements: DataFrame) -> DataFrame:
    """Elements with the place they are stored at: level and cell of their low corner; a box reaches into the next cell of its level at most."""
    width = F.greatest(*[F.col(f"v{x}1") - F.col(f"v{x}0") for x in AXES], F.lit(PLACE_METRES))
    level = F.least(F.ceil(F.log2(width / PLACE_METRES)), F.lit(PLACE_LEVELS)).cast("int")
    cell = [F.floor(F.col(f"v{x}0") / (F.lit(PLACE_METRES) * F.pow(F.lit(2.0), level))) for x in AXES]
    return elements.withColumn("place", F.concat_ws("_", level, *cell))


def places_near(new: DataFrame, gap_m: float) -> DataFrame:
    """The places at which stored elements may come within the gap of new ones, on every level."""
    rows = new.select(*[f"v{x}{e}" for x in AXES for e in "01"]).withColumn("level", F.explode(F.array(*[F.lit(k) for k in range(PLACE_LEVELS + 1)])))
    step = F.lit(PLACE_METRES) * F.pow(F.lit(2.0), F.col("level"))
    slack = 2 * gap_m + 1e-6
    for x in AXES:
        # on the coarsest level boxes may be wider than a cell; those are kept apart by near_known
        rows = rows.withColumn(f"c{x}", F.explode(F.sequence(F.floor((F.col(f"v{x}0") - slack) / step) - 1, F.floor((F.col(f"v{x}1") + slack) / step))))
    return rows.select(F.concat_ws("_", "level", "cx", "cy", "cz").alias("place")).distinct()


def near_known(new: DataFrame, known: DataFrame, gap_m: float) -> DataFrame:
    """The known elements that may come within the gap of new ones: those stored at places near one of these (only such folders are read), and within the
    box around all of them."""
    ends = new.agg(*[f(f"v{x}{e}").alias(f"{x}{e}") for x in AXES for e, f in (("0", F.min), ("1", F.max))]).first()
    if ends["x0"] is None:
        return known.where(F.lit(False))
    if "place" in known.columns:
        places = [r["place"] for r in places_near(new, gap_m).limit(MOST_PLACES + 1).collect()]
        if len(places) <= MOST_PLACES:
            known = known.where(F.col("place").isin(places) | F.col("place").startswith(f"{PLACE_LEVELS}_"))
    for x in AXES:
        known = known.where((F.col(f"v{x}0") <= ends[f"{x}1"] + 2 * gap_m) & (F.col(f"v{x}1") >= ends[f"{x}0"] - 2 * gap_m))
    return known


KEY = ["model_id", "element_id"]


def latest(keys: DataFrame) -> DataFrame:
    """The last batch that brought each element (keys: model_id, element_id, batch)."""
    return keys.groupBy(*KEY).agg(F.max("batch").alias("last"))


def current_clashes(clashes: DataFrame, keys: DataFrame) -> DataFrame:
    """Stored clashes (with batch) without those of elements that a later batch has replaced."""
    last = latest(keys)
    side = lambda s: last.select(F.col("model_id").alias(f"model{s}Id"), F.col("element_id").alias(f"element{s}"), F.col("last").alias(f"last{s}"))
    rows = clashes.join(side("A"), ["modelAId", "elementA"]).join(side("B"), ["modelBId", "elementB"])
    return rows.where((F.col("lastA") <= F.col("batch")) & (F.col("lastB") <= F.col("batch"))).select(*clashes.columns)


def detect_batch(new: DataFrame, known: DataFrame | None, rules: Rules) -> DataFrame:
    """Clashes among new elements and between new and known ones; gi is unique over both.

    Only for one set against itself (equal scopes), where every pair counts once.
    """
    if rules.model_a != rules.model_b:
        raise ValueError("incremental detection needs equal scopes")
    fresh = scope(new, rules.model_a)
    pairs = broad_phase(fresh, fresh, rules.gap_m, rules, same=True)
    every = fresh
    if known is not None:
        old = near_known(fresh, scope(known, rules.model_a), rules.gap_m)
        pairs = pairs.unionByName(broad_phase(old, fresh, rules.gap_m, rules, same=False))
        every = old.unionByName(fresh)
    return with_identity(clashes_of(pairs, every, rules), every, stable_ids=True)


def start(spark: SparkSession, wire_stream: DataFrame, elements_path: str, clashes_path: str, checkpoint: str, rules: Rules, **trigger) -> StreamingQuery:
    """Runs a stream of wire elements (with gi): each micro-batch is matched with the stored elements and stored itself, by place.

    An element whose key (model_id, element_id) came before replaces the older one from its batch on (see current_clashes; the keys of all batches are
    stored beside the elements, at {elements_path}-keys). Batches are written to folders of their own number, so a batch that runs again
    replaces what it wrote.
    """
    keys_path = elements_path.rstrip("/") + "-keys"

    def stored(path: str) -> DataFrame | None:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        return spark.read.parquet(path) if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where) else None

    def step(batch: DataFrame, number: int) -> None:
        new = with_place(parse_elements(batch, strict=False)).persist()
        known, keys = stored(elements_path), stored(keys_path)
        if known is not None:
            before = near_known(scope(new, rules.model_a), known.where(F.col("batch") < number), rules.gap_m)
            last = latest(keys.where(F.col("batch") < number))
            known = before.join(last, KEY).where(F.col("batch") == F.col("last")).join(new.select(*KEY).distinct(), KEY, "left_anti").select(*new.columns)
        detect_batch(new.drop("place"), None if known is None else known.drop("place"), rules).write.mode("overwrite").parquet(f"{clashes_path}/batch={number}")
        new.select(*KEY).distinct().write.mode("overwrite").parquet(f"{keys_path}/batch={number}")
        new.write.mode("overwrite").partitionBy("place").parquet(f"{elements_path}/batch={number}")
        new.unpersist()

    return wire_stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
