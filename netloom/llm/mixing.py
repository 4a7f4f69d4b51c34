"""Mixing sources to target weights by iterative proportional fitting."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.llm.common import free_name, written

# Topic rules: the first topic with a mark that the text contains, else PROSE.
TOPICS = (("licence", ("icense", "ights reserved", "opyright")), ("table", ("|",)), ("contact", ("@",)))
PROSE = "prose"
UNKNOWN = "unknown"
DIMENSIONS = ("source", "lang", "topic")
TEMPER = 0.8
SHARE = 0.6
TOLERANCE = 1e-9
MAX_SWEEPS = 120
SWEEPS = 8  # sweeps of one plan
FEW_CELLS = 100_000  # cells that one task sweeps; beyond, every step shuffles
WORD = r"[^\x20\x09-\x0D]+"


def topic_of(text: str = "text") -> Column:
    """Topic of a text by TOPICS; null texts are prose."""
    found = F.lit(None).cast("string")
    for name, marks in reversed(TOPICS):
        hit = F.lit(False)
        for mark in marks:
            hit = hit | F.contains(F.col(text), F.lit(mark))
        found = F.when(hit, F.lit(name)).otherwise(found)
    return F.coalesce(found, F.lit(PROSE))


def words_of(text: str = "text") -> Column:
    """Words between blanks, the token weight if no tokenizer's count is at hand; null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def draw_of(key: str, seed: int) -> Column:
    """A number in [0, 1) from the keyed hash of a row's key; a null key hashes as the empty string."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / float(1 << 32)


def tempered(cells: DataFrame, dimension: str, power: float) -> DataFrame:
    """Target shares (value, target) of a dimension: its token shares raised to `power`."""
    sums = cells.groupBy(dimension).agg(F.sum("tokens").cast("double").alias("mass")).where("mass > 0")
    raised = sums.select(F.col(dimension).alias("value"), F.pow("mass", F.lit(power)).alias("target"))
    return raised.crossJoin(F.broadcast(raised.agg(F.sum("target").alias("total")))).select(
        "value", (F.col("target") / F.col("total")).alias("target")
    )


def given(cells: DataFrame, dimension: str, shares: Mapping[str, float]) -> DataFrame:
    """Given target shares, normalised over the values that have tokens; values not named get none."""
    present = cells.where("tokens > 0").select(F.col(dimension).alias("value")).distinct()
    named = cells.sparkSession.createDataFrame(list(shares.items()) or [(None, 0.0)], "value string, target double")
    kept = named.join(present, "value").where("target > 0")
    return kept.crossJoin(F.broadcast(kept.agg(F.sum("target").alias("total")))).select(
        "value", (F.col("target") / F.col("total")).alias("target")
    )


def rake(cells: DataFrame, targets: Mapping[str, DataFrame], tolerance: float = TOLERANCE) -> DataFrame:
    """Cells with `rate`, the factor on their tokens that meets all marginal targets, and `gap`.

    A sweep multiplies each cell's mass by what its value lacks, one dimension
    after the other, so that each margin is met in turn. One plan makes SWEEPS
    sweeps and stores the masses; sweeps end when none of the last one's factors
    is further from 1 than `tolerance`, or after MAX_SWEEPS. `gap` is that largest
    distance: above the tolerance the targets contradict each other. Cells of a
    value without a target get the rate 0. A table of at most FEW_CELLS cells is
    swept in one task without shuffles, a larger one by a shuffle per dimension.
    """
    names = list(targets)
    mass, moved = free_name(cells, "mass"), free_name(cells, "moved")
    goals = {d: free_name(cells, f"goal_{d}") for d in names}
    live = cells.where("tokens > 0").withColumns({mass: F.col("tokens").cast("double"), moved: F.lit(0.0)})
    for d in names:
        live = live.join(targets[d].select(F.col("value").alias(d), F.col("target").alias(goals[d])), d)
    live = written(live, "mix-mass")
    few = live.limit(FEW_CELLS + 1).count() <= FEW_CELLS
    gap = 0.0
    for _ in range(0, MAX_SWEEPS, SWEEPS):
        swept = live.coalesce(1) if few else live
        for _ in range(SWEEPS):
            swept = swept.withColumn(moved, F.lit(0.0))
            for d in names:
                factor = F.col(goals[d]) / F.sum(mass).over(Window.partitionBy(d))
                swept = swept.withColumn("_factor", factor).withColumns(
                    {mass: F.col(mass) * F.col("_factor"), moved: F.greatest(moved, F.abs(F.col("_factor") - 1))}
                )
        live = written(swept.drop("_factor"), "mix-mass")
        gap = live.agg(F.max(moved)).first()[0] or 0.0
        if gap <= tolerance:
            break
    rated = live.select(*names, (F.col(mass) / F.col("tokens")).alias("rate"))
    return cells.where("tokens > 0").join(rated, names, "left").select(
        *names, "tokens", F.coalesce("rate", F.lit(0.0)).alias("rate"), F.lit(float(gap)).alias("gap")
    )


def calibrated(rated: DataFrame, share: float) -> DataFrame:
    """Cells with `probability`: min(1, level * rate), at the level that keeps `share` of all tokens.

    If cells with a rate hold fewer tokens than that, all of these are kept.
    """
    rated = written(rated, "mix-rates")
    level = 0.0
    while True:  # Each round fills up one more cell at least, or ends.
        full = F.col("rate") * level >= 1
        sums = rated.agg(
            F.sum("tokens").alias("all"),
            F.sum(F.when(full, F.col("tokens"))).alias("full"),
            F.sum(F.when(~full, F.col("tokens") * F.col("rate"))).alias("open"),
        ).first()
        if not sums["open"]:
            break
        raised = (share * sums["all"] - (sums["full"] or 0)) / sums["open"]
        if raised <= level * (1 + 1e-12):
            break
        level = raised
    return rated.withColumn("probability", F.least(F.lit(1.0), F.col("rate") * level))


def described(df: DataFrame, text: str = "text", tokens: Column | None = None, topic: Column | None = None) -> DataFrame:
    """`row`, source, lang, topic and tokens of every row; null sources and languages are `unknown`."""
    return df.select(
        F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"),
        F.coalesce("source", F.lit(UNKNOWN)).alias("source"),
        F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"),
        F.coalesce(topic_of(text) if topic is None else topic, F.lit(UNKNOWN)).alias("topic"),
        F.coalesce(words_of(text) if tokens is None else tokens, F.lit(0)).cast("long").alias("tokens"),
    )


def probabilities(
    rows: DataFrame,
    targets: Mapping[str, Mapping[str, float]] | None = None,
    power: float = TEMPER,
    share: float = SHARE,
) -> DataFrame:
    """(source, lang, topic, probability) of every cell of `described` rows that has tokens.

    `targets` gives shares per dimension; a dimension it does not name has its
    own token shares raised to `power`, which lifts rare values.
    """
    cells = written(rows.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens")), "mix-cells")
    wanted = targets or {}
    goals = {
        d: given(cells, d, wanted[d]) if d in wanted else tempered(cells, d, power) for d in DIMENSIONS
    }
    return calibrated(rake(cells, goals), share).select(*DIMENSIONS, "probability")


def chosen(rows: DataFrame, cells: DataFrame, key: Column, seed: int) -> DataFrame:
    """Rows with the probability of their cell and `kept`, drawn by the keyed hash of `key`.

    Rows of a cell without tokens take nothing from any share and stay.
    """
    named = rows.join(cells, list(DIMENSIONS), "left").withColumn("_key", key)
    named = named.withColumn("probability", F.coalesce("probability", F.lit(1.0)))
    return named.withColumn("kept", draw_of("_key", seed) < F.col("probability")).drop("_key")


def mixing_report(df: DataFrame, power: float = TEMPER, share: float = SHARE, seed: int = 3) -> DataFrame:
    """doc_id, source, lang, topic, tokens, probability (6 digits) and kept of every document."""
    slim = described(df).withColumn("row", F.struct("row.doc_id"))
    rows = written(slim, "mix-rows")
    picked = chosen(rows, probabilities(rows, power=power, share=share), F.col("row.doc_id"), seed)
    return picked.select("row.doc_id", *DIMENSIONS, "tokens", F.round("probability", 6).alias("probability"), "kept")


def sample(
    df: DataFrame,
    targets: Mapping[str, Mapping[str, float]] | None = None,
    power: float = TEMPER,
    share: float = SHARE,
    key: str = "doc_id",
    seed: int = 3,
) -> DataFrame:
    """The rows of `df` that the mixture draws, with its columns."""
    rows = described(df)
    cells = probabilities(rows.drop("row"), targets, power, share)
    return chosen(rows, written(cells, "mix-cells"), F.col(f"row.`{key}`"), seed).where("kept").select("row.*")


def report_sql(power: float = TEMPER, share: float = SHARE, seed: int = 3, sweeps: int = 60) -> str:
    """DuckDB form of `mixing_report`: sweeps as a recursive query over the cells."""
    cases = " ".join(
        f"WHEN {' OR '.join(f"contains(text, '{m}')" for m in marks)} THEN '{name}'" for name, marks in TOPICS
    )
    goal = "\n".join(
        f"""g_{d} AS (SELECT {d}, pow(sum(tokens), {power}) / sum(pow(sum(tokens), {power})) OVER () AS target
        FROM cells WHERE tokens > 0 GROUP BY {d}),"""
        for d in DIMENSIONS
    )
    step = "SELECT k, source, lang, topic, tokens, w FROM mass"
    for d in DIMENSIONS:
        step = f"""SELECT k, source, lang, topic, tokens, w * target / sum(w) OVER (PARTITION BY {d}) AS w
        FROM ({step}) JOIN g_{d} USING ({d})"""
    return f"""WITH RECURSIVE docs AS (SELECT doc_id, coalesce(source, '{UNKNOWN}') AS source, coalesce(lang, '{UNKNOWN}') AS lang,
      CASE {cases} ELSE '{PROSE}' END AS topic,
      CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS tokens FROM documents),
    cells AS (SELECT source, lang, topic, CAST(sum(tokens) AS DOUBLE) AS tokens FROM docs GROUP BY ALL),
    {goal}
    mass AS (SELECT 0 AS k, source, lang, topic, tokens, tokens AS w FROM cells WHERE tokens > 0
      UNION ALL SELECT k + 1, source, lang, topic, tokens, w FROM ({step}) WHERE k < {sweeps}),
    rated AS (SELECT source, lang, topic, tokens, w / tokens AS rate FROM mass WHERE k = {sweeps}),
    ranked AS (SELECT *, coalesce(sum(tokens) OVER up, 0) AS above, sum(tokens * rate) OVER down AS below
      FROM rated WINDOW up AS (ORDER BY rate DESC, source, lang, topic ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
      down AS (ORDER BY rate DESC, source, lang, topic ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
    level AS (SELECT max(CASE WHEN below > 0 THEN ({share} * (SELECT sum(tokens) FROM cells) - above) / below END) AS level FROM ranked),
    cell AS (SELECT source, lang, topic, least(1.0, rate * level) AS probability FROM rated, level)
    SELECT doc_id, source, lang, topic, tokens, round(coalesce(probability, 1.0), 6) AS probability,
      CAST(('0x' || substr(md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8)) AS BIGINT) / 4294967296.0 < coalesce(probability, 1.0) AS kept
    FROM docs LEFT JOIN cell USING (source, lang, topic)"""
