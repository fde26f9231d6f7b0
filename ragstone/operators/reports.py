"""Report tables: long and wide forms, comparisons of splits, histograms, associations, Markdown and SVG."""

from __future__ import annotations

from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ragstone.functions.vectors import ratio

from .metrics import auroc, average_precision, brier, confusion_rates
from .statistics import fisher_p, mann_whitney, odds_ratio


def long_metrics(df: DataFrame, ids: list[str], metrics: list[str]) -> DataFrame:
    """ids, metric, value, in one pass; nulls stay."""
    return df.select(*ids, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(ids, metrics, "metric", "value")


def compared(df: DataFrame, ids: list[str], split: str, value: str, first: str, second: str) -> DataFrame:
    """ids, first, second, difference and its direction; the splits to pivot are named, so no job is run to find them."""
    wide = df.groupBy(*ids).pivot(split, [first, second]).agg(F.first(value))
    d = F.col(second) - F.col(first)
    direction = F.when(d.isNull(), "undefined").when(d > 0, "higher").when(d < 0, "lower").otherwise("equal")
    return wide.withColumns({"difference": d, "direction": direction})


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """bin, n for every bin of [low, high]; values beyond count in the outermost, the upper bound in the last."""
    width = (high - low) / bins
    place = F.least(F.greatest(F.floor((F.col(value) - low) / width), F.lit(0)), F.lit(bins - 1)).cast("int")
    found = df.filter(F.col(value).isNotNull()).groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(found, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def top_share(df: DataFrame, category: str, n: int) -> DataFrame:
    """The n most frequent categories with their share of all rows."""
    total = df.agg(F.count(F.lit(1)).alias("total"))
    counted = df.groupBy(category).agg(F.count(F.lit(1)).alias("n"))
    return counted.crossJoin(F.broadcast(total)).select(category, "n", (F.col("n") / F.col("total")).alias("share")).orderBy(F.desc("n"), category).limit(n)


def first_per_category(df: DataFrame, category: str, order: str, each: int, most: int) -> DataFrame:
    """Up to `each` rows of a category, then up to `most` in all."""
    nth = F.row_number().over(Window.partitionBy(category).orderBy(order))
    return df.withColumn("nth", nth).filter(F.col("nth") <= each).orderBy(category, "nth").limit(most).drop("nth")


def markdown(df: DataFrame, title: str) -> str:
    """A small table as Markdown: NA for null, six decimals, pipes escaped. It collects, so it's for report tables."""

    def cell(x: object) -> str:
        if x is None:
            return "NA"
        return (f"{x:.6f}" if isinstance(x, float) else str(x)).replace("|", "\\|")

    rows = [" | ".join(cell(x) for x in r) for r in df.collect()]
    head = [" | ".join(df.columns), " | ".join("---" for _ in df.columns)]
    return f"# {title}\n\n" + "".join(f"| {r} |\n" for r in [*head, *rows])


def sections(tables: dict[str, DataFrame]) -> DataFrame:
    """Tables of different columns as one, with the name of each in `section`; what a table lacks is null."""
    out = None
    for name, df in tables.items():
        part = df.withColumn("section", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("no tables")
    return out.select("section", *[c for c in out.columns if c != "section"])


def with_intervals(points: DataFrame, intervals: DataFrame, keys: list[str]) -> DataFrame:
    """Long metrics (keys, metric, value) with lower and upper where an interval is known."""
    return points.join(intervals.select(*keys, "metric", "lower", "upper"), [*keys, "metric"], "left")


def model_metrics(df: DataFrame, y: str, p: str, by: list[str], threshold: float = 0.5, bins: int = 10) -> DataFrame:
    """One row per group: confusion rates at the threshold, auroc, average precision, Brier score and calibration error."""
    said = df.withColumn("__said", (F.col(p) >= threshold).cast("int"))
    rows = confusion_rates(said, y, "__said", by)
    for part in (auroc(df, y, p, by), average_precision(df, y, p, by), brier(df, y, p, by)):
        rows = rows.join(part, by, "left")
    place = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1))
    each = df.groupBy(*by, place.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.abs(F.avg(y) - F.avg(p)).alias("gap"))
    return rows.join(each.groupBy(*by).agg((F.sum(F.col("n") * F.col("gap")) / F.sum("n")).alias("ece")), by, "left")


def discrimination(df: DataFrame, truth: str, prediction: str, score: str, by: list[str]) -> DataFrame:
    """Confusion cells and rates with auroc and average precision of a score, one row per group."""
    rows = confusion_rates(df, truth, prediction, by)
    return rows.join(auroc(df, truth, score, by), by, "left").join(average_precision(df, truth, score, by), by, "left")


def associations(df: DataFrame, group: str, by: list[str], continuous: list[str], binary: list[str]) -> DataFrame:
    """comparison of rows with group 1 against 0, one row per by and metric: sizes, difference of means, Cliff's delta and
    p of Mann and Whitney for continuous ones; difference, ratio (null where the reference is 0) and odds for binary ones,
    with Fisher's exact p. Nulls of a metric are left out for that metric alone."""
    inside, parts = F.col(group) == 1, []
    for name in continuous:
        known = df.filter(F.col(name).isNotNull())
        means = known.groupBy(*by).agg((F.avg(F.when(inside, F.col(name))) - F.avg(F.when(~inside, F.col(name)))).alias("difference"))
        parts.append(
            mann_whitney(known, inside, name, by)
            .join(means, by)
            .select(*by, F.lit(name).alias("metric"), F.lit("continuous").alias("kind"), F.col("n1").cast("long").alias("n1"), F.col("n0").cast("long").alias("n0"), "difference", "cliffs_delta", "p")
        )
    for name in binary:
        a, b = F.count_if(inside & (F.col(name) == 1)).alias("a"), F.count_if(inside & (F.col(name) == 0)).alias("b")
        c, d = F.count_if(~inside & (F.col(name) == 1)).alias("c"), F.count_if(~inside & (F.col(name) == 0)).alias("d")
        cells = df.groupBy(*by).agg(a, b, c, d)
        first, second = ratio(F.col("a"), F.col("a") + F.col("b")), ratio(F.col("c"), F.col("c") + F.col("d"))
        parts.append(
            cells.select(
                *by, F.lit(name).alias("metric"), F.lit("binary").alias("kind"), (F.col("a") + F.col("b")).alias("n1"), (F.col("c") + F.col("d")).alias("n0"),
                (first - second).alias("difference"), ratio(first, second).alias("risk_ratio"), odds_ratio(*map(F.col, "abcd")).alias("odds_ratio"),
                fisher_p("a", "b", "c", "d").alias("p"),
            )
        )
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out


def svg(series: list[dict], title: str, x: str, y: str, width: int = 640, height: int = 400) -> str:
    """A figure as SVG. series: name, kind (line, step, dots, bars), points of (x, y) or, for dots, (x, y, lower, upper).

    Meant for the bounded tables of reports; points with a null are left out."""
    names = [s["name"] for s in series]
    rows = [[p for p in s["points"] if None not in p] for s in series]
    labels = sorted({p[0] for r in rows for p in r if isinstance(p[0], str)})
    place = {v: i for i, v in enumerate(labels)}
    number = lambda v: float(place.get(v, v)) if isinstance(v, str) else float(v)
    xs = [number(p[0]) for r in rows for p in r] or [0.0]
    ys = [float(v) for r in rows for p in r for v in p[1:]] + [0.0]
    left, right, top, bottom = 60, 20, 40, 50
    span = lambda v: (max(v) - min(v)) or 1.0
    px = lambda v: left + (number(v) - min(xs)) / span(xs) * (width - left - right)
    py = lambda v: height - bottom - (float(v) - min(ys)) / span(ys) * (height - top - bottom)
    colours = ("#3366aa", "#cc6633", "#338855", "#884499", "#777777")
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}" font-family="sans-serif" font-size="12">']
    out.append(f'<text x="{width / 2:.1f}" y="20" text-anchor="middle">{escape(title)}</text>')
    out.append(f'<path d="M{left},{top}V{height - bottom}H{width - right}" fill="none" stroke="#000"/>')
    out.append(f'<text x="{width / 2:.1f}" y="{height - 10}" text-anchor="middle">{escape(x)}</text>')
    out.append(f'<text x="15" y="{height / 2:.1f}" transform="rotate(-90 15 {height / 2:.1f})" text-anchor="middle">{escape(y)}</text>')
    for v in (min(ys), max(ys)):
        out.append(f'<text x="{left - 5}" y="{py(v):.1f}" text-anchor="end">{v:.3g}</text>')
    for v in labels or (min(xs), max(xs)):
        out.append(f'<text x="{px(v):.1f}" y="{height - bottom + 15}" text-anchor="middle">{escape(v if isinstance(v, str) else f"{v:.3g}")}</text>')
    for i, (s, points) in enumerate(zip(series, rows)):
        colour = colours[i % len(colours)]
        if s["kind"] in ("line", "step") and points:
            way = [f"{px(p[0]):.1f},{py(p[1]):.1f}" for p in points]
            if s["kind"] == "step":
                way = [way[0], *[f"{px(b[0]):.1f},{py(a[1]):.1f} {px(b[0]):.1f},{py(b[1]):.1f}" for a, b in zip(points, points[1:])]]
            out.append(f'<polyline points="{" ".join(way)}" fill="none" stroke="{colour}"/>')
        for p in points:
            if s["kind"] == "bars":
                w = max(2.0, 0.8 * (width - left - right) / max(1, len(points)))
                out.append(f'<rect x="{px(p[0]) - w / 2:.1f}" y="{py(p[1]):.1f}" width="{w:.1f}" height="{py(min(ys)) - py(p[1]):.1f}" fill="{colour}"/>')
            elif s["kind"] == "dots":
                out.append(f'<circle cx="{px(p[0]):.1f}" cy="{py(p[1]):.1f}" r="4" fill="{colour}"/>')
                if len(p) == 4:
                    out.append(f'<path d="M{px(p[0]):.1f},{py(p[2]):.1f}V{py(p[3]):.1f}" stroke="{colour}"/>')
        out.append(f'<text x="{width - right}" y="{top + 15 * i}" text-anchor="end" fill="{colour}">{escape(names[i])}</text>')
    return "\n".join([*out, "</svg>\n"])


def question_matrix(rows: list[tuple[str, str, str]]) -> str:
    """Research questions as Markdown: (question, metric, where its numbers stand)."""
    head = "| question | metric | evidence |\n| --- | --- | --- |\n"
    return head + "".join("| " + " | ".join(str(c).replace("|", "\\|") for c in r) + " |\n" for r in rows)


def result_text(tests: DataFrame, alpha: float = 0.05) -> str:
    """One sentence per test of a bounded table (comparison, metric, difference, p_holm), in its order."""
    said = []
    for r in tests.collect():
        verdict = "undefined" if r["p_holm"] is None else "rejected" if r["p_holm"] < alpha else "not rejected"
        number = lambda v: "NA" if v is None else f"{v:.6f}"
        said.append(f"- {r['comparison']}, {r['metric']}: difference {number(r['difference'])}, adjusted p {number(r['p_holm'])}, {verdict} at {alpha}.")
    return "\n".join(said) + "\n"
