"""Join-shaped operators. Ambiguity is never resolved by picking a match: a
key counts only with exactly one distinct target."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.releases import release_key
from .asof import asof_join
from .folds import numbered


def unique_targets(pairs: DataFrame, key: str, target: str) -> DataFrame:
    """Keys with exactly one distinct target. Minimum and maximum tell that
    with a map-side aggregate, without counting distinct values."""
    grouped = pairs.where(F.col(key).isNotNull() & F.col(target).isNotNull()).groupBy(key).agg(F.min(target).alias(target), F.max(target).alias("last_"))
    return grouped.where(F.col(target) == F.col("last_")).drop("last_")


def resolve_unique(links: DataFrame, keys: DataFrame, link: str, key: str, target: str) -> DataFrame:
    """links (link id, key rows) against keys (key, target): n_targets, and
    the target where all keys of a link agree on one (zero: keep; more: warn)."""
    found = links.join(keys.select(key, target).distinct(), key, "left").groupBy(link).agg(F.min(target).alias("lo_"), F.max(target).alias("hi_"), F.count_distinct(target).alias("n_targets"))
    action = F.when(F.col("n_targets") == 0, "keep").when(F.col("n_targets") > 1, "warn").otherwise("rewrite")
    return found.select(link, "n_targets", F.when(F.col("lo_") == F.col("hi_"), F.col("lo_")).alias("target"), action.alias("action"))


def resolve_documents(guides: DataFrame, mappings: DataFrame, release: str, platform: str) -> DataFrame:
    """guides joined with their mapping of a release and platform."""
    return guides.join(mappings.where((F.col("release") == release) & (F.col("platform") == platform)), "guide_id")


def override(base: DataFrame, over: DataFrame, keys: list[str], value: str, origin: str) -> DataFrame:
    """Values of `over` in place of those of `base`, and where each is from."""
    new = over.select(*keys, F.col(value).alias("over_"))
    out = base.join(new, keys, "left")
    return out.withColumns({value: F.coalesce("over_", value), origin: F.when(F.col("over_").isNotNull(), "override").otherwise("mapping")}).drop("over_")


def neighbour_releases(mappings: DataFrame, by: list[str]) -> DataFrame:
    """The nearest mapped release before and after each, by release order."""
    w = Window.partitionBy(*by).orderBy("key_")
    out = mappings.withColumn("key_", release_key(F.col("release")))
    return out.withColumns({"before": F.lag("release").over(w), "after": F.lead("release").over(w)}).drop("key_")


def nearest_releases(wanted: DataFrame, mappings: DataFrame, by: list[str]) -> DataFrame:
    """wanted (by, release) with the nearest other mapped release before and
    after it and their targets (null: none). A key that most mappings share is
    cut by ranges; of mappings of one release the greatest target counts."""
    known = mappings.withColumn("key_", release_key(F.col("release")))
    out, time = wanted, lambda: release_key(F.col("release"))
    for side, forward in (("before", False), ("after", True)):
        out = asof_join(out, known, by, time(), F.col("key_"), {side: "release", f"{side}_target": "target"}, forward=forward, strict=True)
    return out


def peer_targets(mappings: DataFrame, platform: str, release: str) -> DataFrame:
    """For guides mapped or not in a release: the target that the platform's
    peers agree on. Peers shared the platform's target in the nearest release
    before and after that maps it; each such release must have a peer."""
    keyed = mappings.withColumn("k", release_key(F.col("release")))
    now = release_key(F.lit(release))
    own = keyed.where((F.col("platform") == platform) & (F.col("release") != release))
    near = own.groupBy("guide_id").agg(
        F.max_by(F.struct("release", "target"), F.when(F.col("k") < now, F.col("k"))).alias("b"),
        F.min_by(F.struct("release", "target"), F.when(F.col("k") > now, F.col("k"))).alias("a"),
    )
    sides = near.select("guide_id", F.explode(F.array("b", "a")).alias("s")).where("s is not null").select("guide_id", "s.release", F.col("s.target").alias("own_target"))
    others = mappings.where(F.col("platform") != platform)
    peers = sides.join(others, ["guide_id", "release"], "left").withColumn("peer", F.when(F.col("target") == F.col("own_target"), F.col("platform")))
    shared = peers.groupBy("guide_id", "release").agg(F.collect_set("peer").alias("peers"))
    whole = shared.groupBy("guide_id").agg(F.bool_and(F.size("peers") > 0).alias("all_shared"), F.array_distinct(F.flatten(F.collect_list("peers"))).alias("peers"), F.sort_array(F.collect_set("release")).alias("releases"))
    here = mappings.where(F.col("release") == release).select("guide_id", F.col("platform").alias("peer"), "target")
    agree = whole.where("all_shared").select("guide_id", "releases", F.explode("peers").alias("peer")).join(here, ["guide_id", "peer"])
    one = agree.groupBy("guide_id", "releases").agg(F.min("target").alias("target"), F.max("target").alias("last_"), F.sort_array(F.collect_set("peer")).alias("peers")).where("target = last_")
    mine = here.where(F.col("peer") == platform).select("guide_id", F.col("target").alias("mine_"))
    return one.join(mine, "guide_id", "left").where("mine_ is null or mine_ != target").select("guide_id", "target", "peers", "releases")


def missing(required: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    """Required rows that are not present."""
    return required.join(present.select(*keys).distinct(), keys, "left_anti")


def restored(links: DataFrame, pages: DataFrame, current: DataFrame, previous: DataFrame, key: str, value: str) -> DataFrame:
    """Links to pages that are gone: the current record beats the previous."""
    gone = links.join(pages.select(key).distinct(), key, "left_anti")
    out = gone.join(current.select(key, F.col(value).alias("c_")), key, "left").join(previous.select(key, F.col(value).alias("p_")), key, "left")
    return out.withColumn(value, F.coalesce("c_", "p_")).drop("c_", "p_")


def compare(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Full outer comparison: same, changed, only left or only right."""
    a, b = left.select(*keys, F.col(value).alias("left_value"), F.lit(True).alias("in_l")), right.select(*keys, F.col(value).alias("right_value"), F.lit(True).alias("in_r"))
    status = F.when(F.col("in_r").isNull(), "only left").when(F.col("in_l").isNull(), "only right").when(F.col("left_value").eqNullSafe(F.col("right_value")), "same").otherwise("changed")
    return a.join(b, keys, "full").select(*keys, "left_value", "right_value", status.alias("status"))


def first_served(candidates: DataFrame, key: str, order: str, served: str, value: str) -> DataFrame:
    """The first candidate of each key that is served."""
    return candidates.groupBy(key).agg(F.min_by(value, F.when(F.col(served), F.col(order))).alias(value))


def overlaps(lines: DataFrame, width: float = 0.25, height: float = 0.55, area: float = 0.18) -> DataFrame:
    """Pairs of lines of a page with different texts whose boxes overlap by
    more than the shares of the smaller one. The join is on the page and a
    grid row of the page, so a page's pairs are not all formed: boxes meet in
    the grid row where their overlap begins."""
    cell = 32.0
    cells = F.explode(F.sequence(F.floor(F.col("y0") / cell).cast("int"), F.floor(F.col("y1") / cell).cast("int"))).alias("cell_")
    a = lines.select(*(F.col(c).alias(f"{c}_a") for c in ("ord", "text", "x0", "y0", "x1", "y1")), "page", cells)
    b = lines.select(*(F.col(c).alias(f"{c}_b") for c in ("ord", "text", "x0", "y0", "x1", "y1")), "page", cells)
    w = F.least("x1_a", "x1_b") - F.greatest("x0_a", "x0_b")
    h = F.least("y1_a", "y1_b") - F.greatest("y0_a", "y0_b")
    size = lambda s: (F.col(f"x1_{s}") - F.col(f"x0_{s}")) * (F.col(f"y1_{s}") - F.col(f"y0_{s}"))
    span = lambda lo, hi, s: F.col(f"{hi}_{s}") - F.col(f"{lo}_{s}")
    pairs = a.join(b, ["page", "cell_"]).where((F.col("ord_a") < F.col("ord_b")) & (F.col("text_a") != F.col("text_b")) & (w > 0) & (h > 0))
    pairs = pairs.where(F.floor(F.greatest("y0_a", "y0_b") / cell) == F.col("cell_"))
    shares = pairs.select("page", "ord_a", "ord_b", (w / F.least(span("x0", "x1", "a"), span("x0", "x1", "b"))).alias("width"), (h / F.least(span("y0", "y1", "a"), span("y0", "y1", "b"))).alias("height"), (w * h / F.least(size("a"), size("b"))).alias("area"))
    return shares.where((F.col("width") >= width) & (F.col("height") >= height) & (F.col("area") >= area))


def accept(candidates: DataFrame, previous: DataFrame, missing_now: DataFrame, missing_before: DataFrame) -> DataFrame:
    """May a candidate guide replace the previous one? A complete one may; a
    degraded one only a degraded one, and only if it misses nothing new."""
    worse = missing_now.join(missing_before, ["guide", "resource"], "left_anti").select("guide").distinct().withColumn("worse_", F.lit(True))
    out = candidates.join(previous.select("guide", F.col("status").alias("before")), "guide", "left").join(worse, "guide", "left")
    ok = F.when(F.col("status") == "complete", True).when(F.col("status") != "degraded", False).when(F.col("before").isNull(), True).when(F.col("before") == "complete", False).otherwise(F.col("worse_").isNull())
    return out.select("guide", "status", "before", ok.alias("accepted"))


def covered(needed: DataFrame, candidates: DataFrame) -> DataFrame:
    """needed (broken, base, family), candidates (base, sheet, defined): the
    one candidate of the same name that defines every needed family (itself or
    a longer name that begins with it and a hyphen)."""
    own = needed.join(candidates.select("base", "sheet").distinct(), "base")
    hit = own.join(candidates.select("sheet", "defined"), "sheet").where((F.col("defined") == F.col("family")) | F.col("defined").startswith(F.concat("family", F.lit("-"))))
    counts = own.groupBy("broken", "sheet").agg(F.count_distinct("family").alias("n"))
    full = counts.join(hit.groupBy("broken", "sheet").agg(F.count_distinct("family").alias("h")), ["broken", "sheet"]).where("n = h")
    return unique_targets(full, "broken", "sheet").join(unique_targets(own, "broken", "sheet"), ["broken", "sheet"])


def name_clashes(names: DataFrame, key: str, name: str) -> DataFrame:
    """Names that two keys share but for case."""
    fold = names.select(F.lower(name).alias("folded"), F.col(key))
    return fold.groupBy("folded").agg(F.sort_array(F.collect_set(key)).alias("keys")).where(F.size("keys") > 1)


def with_tables(base: DataFrame, *tables: tuple[DataFrame, Column | str, str]) -> DataFrame:
    """A listing: base left-joined with each table on its key."""
    for table, on, how in tables:
        base = base.join(table, on, how)
    return base


def prefixed(values: DataFrame, texts: DataFrame, value: str) -> DataFrame:
    """(value, n): how many distinct longer texts begin with each distinct
    value. Values and texts are numbered in byte order; the texts that begin
    with a value stand between the value and the value with a byte that no text
    has behind it, so the difference of two running counts tells their number
    and no value meets a text."""
    key = F.encode(F.col(value), "utf-8")
    row = lambda df, k, kind, n: df.select(k.alias("key_"), F.lit(kind).alias("kind_"), F.col(value), F.lit(n).cast("long").alias("n_"))
    known, said = (df.select(value).where(F.col(value).isNotNull()).distinct() for df in (values, texts))
    ends = F.concat(key, F.lit(bytearray(b"\xff")))
    rows = row(said, key, 0, 1).unionByName(row(known, key, 1, 0)).unionByName(row(known, ends, 1, 0))  # a text before the value that equals it
    counted = numbered(rows, [], ["key_", "kind_"], "before_", weight="n_").where("kind_ = 1")
    return counted.groupBy(value).agg((F.max("before_") - F.min("before_")).alias("n"))


def explained(values: DataFrame, texts: DataFrame, commands: DataFrame, value: str, least: int = 32) -> DataFrame:
    """values with whether the source explains their repetition: the text
    occurs twice or more, or it has `least` characters or more and begins two
    or more longer command rows."""
    often = texts.groupBy(value).agg(F.count("*").alias("n_")).where("n_ >= 2").select(value)
    begun = prefixed(values.where(F.char_length(value) >= least), commands, value).where("n >= 2").select(value)
    found = often.unionByName(begun).distinct().withColumn("explained", F.lit(True))
    return values.join(found, value, "left").fillna(False, ["explained"])
