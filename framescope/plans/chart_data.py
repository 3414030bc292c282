"""Chart on request: ``chart_data(df, spec)`` returns ``(metadata, frame)``
for a chart spec ``{chart_type, x_column, y_column, column}``.

A rule per chart type says which spec fields may name the drawn column (the
first one given counts), whether both axes are needed, and which operator
makes the frame."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame

from ..functions.classes import classify, validate_columns
from ..operators import charts


@dataclass(frozen=True)
class ChartSpec:
    chart_type: str
    x_column: str | None = None
    y_column: str | None = None
    column: str | None = None


@dataclass(frozen=True)
class ChartMeta:
    chart_type: str
    x_axis: str | None
    y_axis: str | None
    column: str | None


@dataclass(frozen=True)
class Rule:
    """``target``: fields that may name the column, in order; empty for
    charts of both axes. ``frame(df, spec, target)`` makes the data."""

    title: str
    frame: Callable[[DataFrame, ChartSpec, str | None], DataFrame]
    target: tuple[str, ...] = ()
    axes: bool = False


def _box(df: DataFrame, spec: ChartSpec, target: str) -> DataFrame:
    return charts.box_summary(df, target, by=spec.x_column if spec.x_column != target else None)


def _heatmap(df: DataFrame, spec: ChartSpec, target: None) -> DataFrame:
    numeric = classify(df).numeric
    if len(numeric) < 2:
        raise ValueError(f"a heatmap compares numeric columns; the table has {len(numeric)}")
    return charts.heatmap(df, columns=numeric)


# The chart types and their titles.
RULES = {
    "bar": Rule("Bar", lambda df, s, t: charts.bar_counts(df, t), ("x_column", "y_column", "column")),
    "line": Rule("Line", lambda df, s, t: charts.line_series(df, s.x_column, s.y_column), axes=True),
    "scatter": Rule("Scatter Plot", lambda df, s, t: charts.scatter_pairs(df, s.x_column, s.y_column), axes=True),
    "histogram": Rule("Histogram", lambda df, s, t: charts.histogram(df, t), ("column", "x_column")),
    "pie": Rule("Pie", lambda df, s, t: charts.pie_shares(df, t), ("column", "x_column")),
    "box": Rule("Box", _box, ("column", "y_column", "x_column")),
    "heatmap": Rule("Heatmap", _heatmap),
    "area": Rule("Area", lambda df, s, t: charts.area_series(df, s.x_column, s.y_column), axes=True),
}
#: A bar chart of two columns shows means instead of counts.
MEANS = Rule("Bar", lambda df, s, t: charts.bar_mean_by_category(df, s.x_column, s.y_column), axes=True)


def chart_data(df: DataFrame, spec: ChartSpec) -> tuple[ChartMeta, DataFrame]:
    rule = RULES.get(spec.chart_type)
    if rule is None:
        raise ValueError(f"no chart type '{spec.chart_type}'; there are {', '.join(RULES)}")
    validate_columns(df, spec.x_column, spec.y_column, spec.column)
    both = bool(spec.x_column and spec.y_column)
    if spec.chart_type == "bar" and both:
        rule = MEANS
    if rule.axes and not both:
        raise ValueError(f"chart '{spec.chart_type}' needs x_column and y_column")
    target = next((getattr(spec, f) for f in rule.target if getattr(spec, f)), None)
    if rule.target and target is None:
        raise ValueError(f"chart '{spec.chart_type}' needs one of {', '.join(rule.target)}")
    meta = ChartMeta(rule.title, spec.x_column, spec.y_column, target or spec.column)
    if spec.chart_type == "bar" and not both:
        meta = replace(meta, x_axis="Count", y_axis=target)
    return meta, rule.frame(df, spec, target)
