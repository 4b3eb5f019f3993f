"""Reports and checks of caches, audio, reviews and alignments."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexispan.functions import measures as M
from lexispan.operators import intervals as I
from lexispan.operators import resampling as RS
from lexispan.operators import sampling as SA
from lexispan.sources.scratch import written

EDGE = 1e-6
#: Share of the values on either side of a quantile's estimate that are put in order.
AROUND = 0.0005


def _quantile(value: Column, share: float) -> Column:
    """Linear between neighbours, to four places."""
    return M.round4(F.percentile(value, F.lit(share)))


def store_statistics(rows: DataFrame, status: str, licence: str, part: str = "nc") -> DataFrame:
    """Counts by status and by licence, of all, and of licences with a given part between hyphens, in one pass."""
    has_part = F.array_contains(F.split(F.lower(licence), "-"), part)
    sets = rows.groupingSets([[status], [licence], []], status, licence).agg(
        F.grouping_id().alias("_set"), F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(has_part, F.lit(False))).alias("_part")
    )
    named = F.when(F.col("_set") == 1, F.array(F.struct(F.lit("status").alias("kind"), F.col(status).alias("name"), "n")))
    named = named.when(F.col("_set") == 2, F.array(F.struct(F.lit("license").alias("kind"), F.col(licence).alias("name"), "n")))
    total = F.struct(F.lit("total").alias("kind"), F.lit(None).cast("string").alias("name"), "n")
    non_commercial = F.struct(F.lit("non_commercial").alias("kind"), F.lit(None).cast("string").alias("name"), F.col("_part").alias("n"))
    return sets.select(F.inline(named.otherwise(F.array(total, non_commercial))))


def system_summary(results: DataFrame, cell: list[str], tolerances: list[float], minimum: int = 50) -> DataFrame:
    """Timing errors of one system by cell, from a row for each segment: video, status, coverage, seconds, clip_start, clip_end
    and deltas (an array). Failed segments, and those without deltas, count as failures; rows without a status don't count;
    a cell without any delta gives no row. Within-shares are named by their milliseconds."""
    failed = F.col("status").isin("failed", "unavailable")
    kept = results.where(F.col("status").isNotNull()).withColumn("deltas", F.when(~failed, F.col("deltas")))
    long = kept.select(*cell, "video", "coverage", "seconds", "clip_start", "clip_end", F.posexplode_outer("deltas").alias("pos", "delta"))
    first, size = F.col("pos").isNull() | (F.col("pos") == 0), F.abs("delta")
    seconds = F.sum(F.when(first, F.col("seconds")))
    audio = F.sum(F.when(first, F.greatest(F.col("clip_end") - F.col("clip_start"), F.lit(0.0))))
    within = [M.round4(M.ratio(F.count_if(size <= t), F.count("delta"))).alias(f"within_{round(t * 1000)}ms") for t in tolerances]
    out = long.groupBy(*cell).agg(
        F.count_if(F.col("pos") == 0).alias("segments"),
        F.count_distinct(F.when(F.col("delta").isNotNull(), F.col("video"))).alias("videos"),
        F.count("delta").alias("words"),
        _quantile(size, 0.5).alias("median_abs"),
        _quantile(size, 0.9).alias("p90_abs"),
        _quantile(F.col("delta"), 0.5).alias("median_signed"),
        *within,
        M.round4(F.avg(F.when(F.col("pos") == 0, F.col("coverage")))).alias("coverage"),
        F.count_if(F.col("pos").isNull()).alias("failures"),
        F.coalesce(M.round4(M.ratio(seconds, audio)), F.lit(0.0)).alias("seconds_per_audio_second"),
    )
    return out.where("words > 0").withColumn("indicative_only", F.col("segments") < minimum)


def system_intervals(results: DataFrame, cell: list[str], tolerance: float = 0.2, rounds: int = 1000, seed: str = "12345") -> DataFrame:
    """For the rows of ``system_summary``, the 95 % intervals of the median error and of the share within ``tolerance``, videos resampled
    whole; null for cells of fewer than two videos."""
    scored = results.where(F.col("status").isNotNull() & ~F.col("status").isin("failed", "unavailable"))
    deltas = scored.select(*cell, "video", F.explode("deltas").alias("delta"))
    return RS.error_intervals(deltas, cell, "video", "delta", tolerance, rounds, seed)


def engine_agreement(left: DataFrame, right: DataFrame, keys: list[str], tolerance: float = 0.2) -> DataFrame:
    """Differences of start between two systems for the same text of the same row, as one row. Of texts that the right system has
    twice in a row, the last by ``ord`` counts; each of the left's is compared."""
    last = right.groupBy(*keys).agg(F.max_by("start", "ord").alias("other"))
    delta = F.col("start") - F.col("other")
    deltas = written(left.join(last, keys).select(delta.alias("delta")).where("delta is not null"), "agreement-deltas")
    size = F.abs("delta")
    n = deltas.count()
    told = {"median_abs": exact_quantile(deltas, size, n, 0.5), "p90_abs": exact_quantile(deltas, size, n, 0.9), "median_signed": exact_quantile(deltas, F.col("delta"), n, 0.5)}
    return deltas.agg(
        F.count(F.lit(1)).alias("pairs"), *(M.round4(F.lit(v).cast("double")).alias(c) for c, v in told.items()),
        M.round4(M.ratio(F.count_if(size <= tolerance), F.count(F.lit(1)))).alias("within"),
    )


def exact_quantile(rows: DataFrame, value: Column, n: int, share: float) -> float | None:
    """The quantile of ``value`` (no nulls) of ``n`` rows, linear between neighbours. An estimate tells between which values it lies; those below are counted,
    and only those between are put in order, about a share of 2 * ``AROUND`` of all. If it doesn't lie there, more are."""
    if not n:
        return None
    low = int(share * (n - 1))
    ranks, around = (low, min(low + 1, n - 1)), AROUND
    rows = rows.select(value.alias("v"))
    while True:
        ends = [max(0.0, share - around), min(1.0, share + around)]
        least, most = rows.agg(F.percentile_approx("v", ends, int(4 / AROUND))).first()[0] if around < 1 else rows.agg(F.array(F.min("v"), F.max("v"))).first()[0]
        below, inside = rows.agg(F.count_if(F.col("v") < least), F.count_if(F.col("v").between(least, most))).first()
        if below <= ranks[0] and ranks[1] < below + inside:
            break
        around *= 8
    counts = rows.where(F.col("v").between(least, most)).groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    upto = counts.withColumn("upto", F.sum("n").over(Window.orderBy("v")) + below)
    holds = lambda rank: F.max(F.when((F.lit(rank) < F.col("upto")) & (F.lit(rank) >= F.col("upto") - F.col("n")), F.col("v")))
    x, y = upto.agg(*map(holds, ranks)).first()
    part = share * (n - 1) - low
    return x if x == y else (1 - part) * x + part * y


def covered(units: DataFrame, spans: DataFrame, key: str, ident: str, width: float) -> DataFrame:
    """``units`` with the seconds of each that lie inside the union of its key's spans."""
    pairs = I.overlap_join(units.select(key, ident, "start", "end"), I.islands(spans, [key]).select(key, "start", "end"), key, width)
    inside = pairs.groupBy(F.col(f"l.{ident}").alias(ident)).agg(F.sum(I.overlap(*[F.col(c) for c in ("l.start", "l.end", "r.start", "r.end")])).alias("inside"))
    return units.join(inside, ident, "left").withColumn("inside", F.coalesce("inside", F.lit(0.0)))


def half_covered_recall(judged: DataFrame, by: list[str]) -> DataFrame:
    """Utterances, and those at least half inside accepted spans, from covered() rows."""
    half = F.col("inside") >= 0.5 * (F.col("end") - F.col("start"))
    return judged.groupBy(*by).agg(F.count(F.lit(1)).alias("utterances"), F.count_if(half).alias("half_covered"))


def mixed_unit_report(judged: DataFrame) -> DataFrame:
    """How accepted spans fall on unclear units, from covered() rows: untouched, cut, or wholly inside (all but 50 ms)."""
    lasting = F.col("end") - F.col("start")
    none, whole = F.col("inside") <= EDGE, F.col("inside") >= lasting - 0.05
    out = judged.agg(
        F.count(F.lit(1)).alias("units"),
        F.coalesce(F.sum(lasting), F.lit(0.0)).alias("seconds"),
        F.count_if(none).alias("untouched"),
        F.count_if(~none & ~whole).alias("partially_cut"),
        F.count_if(~none & whole).alias("fully_inside_a_span"),
        F.coalesce(F.sum("inside"), F.lit(0.0)).alias("covered_seconds"),
    )
    return out.withColumn("covered_fraction", F.when(F.col("seconds") > 0, F.col("covered_seconds") / F.col("seconds")))


def run_means(runs: DataFrame, windows: DataFrame, key: str, ident: list[str], value: str, width: float) -> DataFrame:
    """Mean of the windows that a run contains or, if it contains none, of those that overlap it."""
    pairs = I.overlap_join(runs, windows, key, width)
    inside = (F.col("r.start") >= F.col("l.start") - EDGE) & (F.col("r.end") <= F.col("l.end") + EDGE)
    got = pairs.groupBy(*[F.col(f"l.{c}").alias(c) for c in ident]).agg(
        F.count_if(inside).alias("_inside"), F.count(F.lit(1)).alias("_all"), F.avg(F.when(inside, F.col(f"r.{value}"))).alias("_mean"), F.avg(f"r.{value}").alias("_any")
    )
    return got.select(*ident, F.when(F.col("_inside") > 0, F.col("_inside")).otherwise(F.col("_all")).alias("n_windows"), F.coalesce("_mean", "_any").alias("mean"))


def merged_usage(first: Column, second: Column) -> Column:
    """Sums of two maps' values by key; a missing or null map or value counts as nothing."""
    empty = F.create_map().cast("map<string,bigint>")
    zero = F.lit(0).cast("bigint")
    return F.map_zip_with(F.coalesce(first, empty), F.coalesce(second, empty), lambda k, a, b: F.coalesce(a, zero) + F.coalesce(b, zero))


def filtered_entries(rows: DataFrame, target_language=None, provider=None, model=None, older_than_days=None, now: Column | None = None) -> DataFrame:
    """Cache entries that meet all given conditions; ``now`` is the time that ages are taken at, the current one if not given."""
    if older_than_days is not None and older_than_days < 0:
        raise ValueError("older_than_days must not be negative")
    wanted = [F.col(c) == v for c, v in (("target_language", target_language), ("provider", provider), ("model", model)) if v is not None]
    if older_than_days is not None:
        wanted.append(F.col("last_accessed_at") < (F.current_timestamp() if now is None else now) - F.make_dt_interval(days=F.lit(older_than_days)))
    return reduce(lambda df, c: df.where(c), wanted, rows)


def newest(rows: DataFrame, at: str, ties: list[str], limit: int) -> DataFrame:
    return rows.orderBy(F.desc(at), *ties).limit(limit)


def cache_listing(stages: dict[str, DataFrame], ties: list[str], limit: int = 100, **conditions) -> DataFrame:
    """The entries last used, of several caches: the newest of each stage first, then the newest of those."""
    tops = [newest(filtered_entries(df, **conditions), "last_accessed_at", ties, limit).withColumn("stage", F.lit(s)) for s, df in stages.items()]
    return newest(reduce(DataFrame.unionByName, tops), "last_accessed_at", ["stage", *ties], limit)


def link_quality(texts: DataFrame, sources: DataFrame, targets: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """Shares of characters and of tokens that links reach on both sides. Tokens are (key, id, chars), edges (key, source, target),
    texts (key, source_chars, target_chars)."""

    def side(tokens: DataFrame, name: str) -> DataFrame:
        linked = edges.select(key, F.col(name).alias("id")).distinct().withColumn("_linked", F.lit(True))
        return tokens.join(linked, [key, "id"], "left").groupBy(key).agg(
            F.coalesce(F.sum(F.when(F.col("_linked"), F.col("chars"))), F.lit(0)).alias(f"_{name}"), M.round4(F.count("_linked") / F.count(F.lit(1))).alias(f"{name}_token_coverage")
        )

    n_edges = edges.groupBy(key).agg(F.count(F.lit(1)).alias("edge_count"))
    joined = texts.join(side(sources, "source"), key, "left").join(side(targets, "target"), key, "left").join(n_edges, key, "left")
    share = lambda s: M.round4(F.coalesce(f"_{s}", F.lit(0)) / F.greatest(F.lit(1), F.col(f"{s}_chars"))).alias(f"{s}_character_coverage")
    return joined.select(key, share("source"), share("target"), F.coalesce("edge_count", F.lit(0)).alias("edge_count"), "source_token_coverage", "target_token_coverage")


def granular_timing(timing: DataFrame, keys: list[str]) -> DataFrame:
    """Whether a text has two character ranges at least; two different timings follow from that. Least and greatest range differ,
    so that no set of ranges is kept."""
    place = F.struct("char_start", "char_end")
    return timing.groupBy(*keys).agg((F.min(place) != F.max(place)).alias("granular"))


def voice_check(rows: DataFrame, by: list[str], shortest: float = 1.5) -> DataFrame:
    """How often the first guess is the labelled language, over utterances that are long enough."""
    lasting = rows.where(F.col("end") - F.col("start") >= shortest)
    return lasting.groupBy(*by).agg(F.count(F.lit(1)).alias("checked"), F.count_if(F.col("top") == F.col("language")).alias("top1_correct"))


def reference_starts(units: DataFrame, clips: DataFrame, key: str, width: float) -> DataFrame:
    """Starts of the units in each clip (both ends included) from the clip's start, blank units left out. Clips are dealt to the time
    buckets that they touch, a unit lies in one."""
    named = units.where(F.trim("text") != "").select(key, "text", "start", F.floor(F.col("start") / width).cast("long").alias("_bucket"))
    dealt = clips.select(
        key, "clip_id", "clip_start", "clip_end", F.explode(F.sequence(F.floor(F.col("clip_start") / width).cast("long"), F.floor(F.col("clip_end") / width).cast("long"))).alias("_bucket")
    )
    met = dealt.join(named, [key, "_bucket"]).where("start >= clip_start and start <= clip_end")
    return met.select("clip_id", "text", M.round4(F.col("start") - F.col("clip_start")).alias("start"))


def contained(tokens: Column, start: Column, end: Column) -> Column:
    """The tokens of an array that lie inside a span."""
    return F.filter(tokens, lambda t: (t["start"] >= start) & (t["end"] <= end))


def priority_order(rows: DataFrame, group: list[str], key: str, priorities: dict[str, int], other: int = 10) -> DataFrame:
    """Keys of a group numbered by given priorities, then by name."""
    rank = reduce(lambda w, kv: w.when(F.col(key) == kv[0], kv[1]), priorities.items(), F.when(F.lit(False), other)).otherwise(other)
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(rank, key)))


def audio_status(rows: DataFrame, verify_checksum: bool = False) -> DataFrame:
    """status and error of source audio: missing without a manifest, failed by the first rule that doesn't hold, else ready. Columns:
    manifest_status, has_raw, extension, checksum, size_bytes, found_size (null without a file), found_checksum."""
    rules = [
        ("acquisition failed", F.col("manifest_status") == "failed"),
        ("no audio record", ~F.col("has_raw")),
        ("unusable extension", F.coalesce(~F.col("extension").rlike("^[a-z0-9]{1,8}$"), F.lit(True))),
        ("no valid checksum", F.coalesce(~F.col("checksum").rlike("^[0-9a-f]{64}$"), F.lit(True))),
        ("no valid byte count", F.coalesce(F.col("size_bytes") <= 0, F.lit(True))),
        ("payload missing", F.col("found_size").isNull()),
        ("size differs", F.col("found_size") != F.col("size_bytes")),
    ]
    if verify_checksum:
        rules.append(("checksum differs", ~F.col("found_checksum").eqNullSafe(F.col("checksum"))))
    missing, error = F.col("manifest_status").isNull(), SA.first_failing(rules)
    status = F.when(missing, "missing").when(error == "eligible", "ready").otherwise("failed")
    return rows.withColumn("status", status).withColumn("error", F.when(~missing & (error != "eligible"), error))


def clip_problems(tolerance_ms: int = 50) -> Column:
    """What keeps a prepared clip from its contract: format, codec, sample_rate, channels, duration_ms against expected_ms."""
    if tolerance_ms < 0:
        raise ValueError("tolerance_ms must not be negative")
    differs = lambda c, v: ~F.col(c).eqNullSafe(F.lit(v))
    late = F.coalesce(F.abs(F.col("duration_ms") - F.col("expected_ms")) > tolerance_ms, F.lit(True))
    return SA.all_failing([("container", differs("format", "wav")), ("codec", differs("codec", "pcm_s16le")), ("rate", differs("sample_rate", 16_000)), ("channels", differs("channels", 1)), ("duration", late)])


def valid_clips(expected: DataFrame, manifests: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Expected clips with whether the cache holds them: a manifest that is equal in all fields, nulls too."""
    both = expected.alias("e").join(manifests.withColumn("_there", F.lit(True)).alias("m"), key, "left")
    same = reduce(lambda a, c: a & F.col(f"e.{c}").eqNullSafe(F.col(f"m.{c}")), fields, F.coalesce("m._there", F.lit(False)))
    return both.select(key, *[F.col(f"e.{c}").alias(c) for c in fields], same.alias("valid"))


def status_projection(rows: DataFrame, language: str, channel: str, status: str, values: list[str]) -> DataFrame:
    """Languages with their channels, each with its counts by status. Rows are counted before channels are gathered."""
    counts = rows.groupBy(language, channel).agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col(status) == v).alias(v) for v in values])
    return counts.groupBy(language).agg(F.sort_array(F.collect_list(F.struct(channel, "total", *values))).alias("channels"))


def agreement_feature(substituted: Column, deleted: Column, inserted: Column, n_reference: Column) -> Column:
    """status, error code, rate and agreement of captions; unavailable where the reference has no tokens to divide by."""
    rate = M.error_rate(substituted, deleted, inserted, n_reference)
    return F.struct(
        F.when(rate.isNull(), "unavailable").otherwise("complete").alias("status"),
        F.when(rate.isNull(), "empty_reference").alias("error"),
        rate.alias("error_rate"),
        F.when(rate.isNotNull(), M.agreement(rate)).alias("agreement"),
    )


def stratum(language: Column, provenance: Column, strata: list[tuple[str, str, str]]) -> Column:
    """The name of the first stratum (name, language, provenance) that a row belongs to; null if none."""
    return reduce(lambda w, s: w.when((language == s[1]) & (provenance == s[2]), s[0]), strata, F.when(F.lit(False), F.lit(None).cast("string")))


def preflight(available: DataFrame, checks: list[tuple[str, Column]]) -> DataFrame:
    """Rows of a sample report with what blocks each, and whether it is ready."""
    return available.withColumn("blockers", SA.all_failing(checks)).withColumn("ready", F.size("blockers") == 0)


def with_decisions(rows: DataFrame, decisions: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """Rows with the last decision on each in place of what they had; rows without one stay as they are."""
    last = decisions.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("_d"))
    joined = rows.join(last, key, "left")
    pick = lambda c: F.when(F.col("_d").isNotNull(), F.col(f"_d.{c}")).otherwise(F.col(c)).alias(c)
    return joined.select(*[pick(c) if c in columns else F.col(c) for c in rows.columns], F.col("_d").isNotNull().alias("imported"))


def not_yet_there(offered: DataFrame, present: DataFrame, key: str) -> DataFrame:
    return offered.join(present.select(key), key, "left_anti")


def with_evidence(candidates: DataFrame, evidence: DataFrame, key: str) -> DataFrame:
    """Candidates with their evidence, those without marked and kept."""
    return candidates.join(evidence.withColumn("_there", F.lit(True)), key, "left").withColumn("missing", F.col("_there").isNull()).drop("_there")


def skip_reason() -> Column:
    """Why a video isn't taken: is_live (a flag that may be null), live_status, duration in seconds (may be null), has_captions."""
    live = F.coalesce("is_live", F.lit(False)) | F.coalesce(F.col("live_status").isin("is_live", "is_upcoming"), F.lit(False))
    return SA.first_failing(
        [("live", live), ("short", F.coalesce(F.col("duration") < 60, F.lit(False))), ("no captions", ~F.col("has_captions"))]
    )


def format_rejection(wanted: str | None, codecs: list[str], least_kbps: float, least_rate: int) -> Column:
    """The first rule that rejects an audio format, or ``eligible``: format_id, family, has_drm, abr, asr, language."""
    no = F.lit(False)
    primary = F.lower(F.substring_index("language", "-", 1))
    dubbed = F.coalesce(primary != wanted, no) if wanted else no
    return SA.first_failing(
        [
            ("missing format_id", F.coalesce(F.col("format_id") == "", F.lit(True))),
            ("no audio codec", F.col("family").isNull()),
            ("digital restrictions", F.coalesce("has_drm", no)),
            ("codec", ~F.col("family").isin(*codecs)),
            ("bitrate", F.coalesce(F.col("abr") < least_kbps, no)),
            ("sample rate", F.coalesce(F.col("asr") < least_rate, no)),
            ("dubbed", dubbed),
        ]
    )


def unreliable_cjk(text: Column, analyzer: Column, n_tokens: Column) -> Column:
    """Han or kana that a general analyzer left in one piece."""
    return F.coalesce(text.rlike("[぀-ヿ㐀-鿿]") & (analyzer == "unicode") & (n_tokens <= 1), F.lit(False))
