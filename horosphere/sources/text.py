"""The text formats: edge lists, coordinates, hidden variables, labels; and their writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from horosphere.functions import geometry as G
from horosphere.operators.ordered import numbered


def rows(spark: SparkSession, path: str) -> DataFrame:
    """(line, tokens) of the lines that are neither blank nor comments; line tells their order in the file, or in a folder's
    files by name."""
    line = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("id"))
    text = spark.read.text(path).select("value", line.alias("line")).withColumn("value", F.trim(F.regexp_replace("value", r"\s+", " ")))
    return text.where("value <> '' and not startswith(value, '#')").select("line", F.split("value", " ").alias("tokens"))


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """(line, name1, name2): the first two names of a row; rows of one name, and self-loops, are left out."""
    return rows(spark, path).where(F.size("tokens") >= 2).select("line", F.col("tokens")[0].alias("name1"), F.col("tokens")[1].alias("name2")).where("name1 <> name2")


def read_parameters(spark: SparkSession, path: str) -> dict[str, float]:
    """beta, mu and whatever else the header gives as '- key: number'."""
    found = {}
    pattern = r"^#\s*-\s*([\w. ]+?):\s*([-+.\deE]+)\s*$"
    given = spark.read.text(path).where(F.col("value").rlike(pattern))  # a line for each parameter
    for r in given.select(F.regexp_extract("value", pattern, 1).alias("key"), F.regexp_extract("value", pattern, 2).alias("x")).collect():
        found[r.key] = float(r.x)
    return found


def read_coordinates(spark: SparkSession, path: str, dim: int) -> DataFrame:
    """name, kappa, theta (dim 1) or pos, hyp_rad."""
    t = F.col("tokens")
    if dim == 1:
        return rows(spark, path).select(t[0].alias("name"), t[1].cast("double").alias("kappa"), t[2].cast("double").alias("theta"), t[3].cast("double").alias("hyp_rad"))
    return rows(spark, path).select(t[0].alias("name"), t[1].cast("double").alias("kappa"), t[2].cast("double").alias("hyp_rad"), F.slice("tokens", 4, dim + 1).cast("array<double>").alias("pos"))


def read_positions(spark: SparkSession, path: str, dim: int = 2, degrees: bool = False) -> DataFrame:
    """name, pos and, with degrees, realdeg, for alignment: rows with or without the hyperbolic radius before the position, told
    by their number of columns; with degrees, two columns more follow it."""
    t = F.col("tokens")
    at = F.size(t) - (dim + 1) - (2 if degrees else 0) + 1
    return rows(spark, path).select(t[0].alias("name"), F.slice(t, at, dim + 1).cast("array<double>").alias("pos"), *([F.element_at(t, -2).cast("double").alias("realdeg")] if degrees else []))


def read_hidden(spark: SparkSession, path: str, dim: int = 1, names: bool = True, positions: bool = False, native: bool = False) -> DataFrame:
    """vid, name, kappa and, if there, theta or pos; native files hold the hyperbolic radius, too, which is skipped."""
    by_line = numbered(rows(spark, path), ["line"], "vid")
    t, k = F.col("tokens"), 1 if names or native else 0
    name = t[0] if k else F.concat(F.lit("v"), F.col("vid"))
    out = [F.col("vid"), name.alias("name"), t[k].cast("double").alias("kappa")]
    if positions or native:
        at = k + 1 + (1 if native and dim > 1 else 0)
        out.append(t[at].cast("double").alias("theta") if dim == 1 else F.slice("tokens", at + 1, dim + 1).cast("array<double>").alias("pos"))
    return by_line.select(*out)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """(name, label); or, of rows of three positions and a label, row i for vertex v<i>."""
    t = F.col("tokens")
    if len((rows(spark, path).first() or ([], []))[1]) == 2:
        return rows(spark, path).select(t[0].alias("name"), t[1].alias("label"))
    by_line = numbered(rows(spark, path), ["line"], "place")
    return by_line.select(F.concat(F.lit("v"), "place").alias("name"), F.element_at(t, -1).alias("label"))


def with_labels(coordinates: DataFrame, labels: DataFrame) -> DataFrame:
    """coordinates (name, ...) with the label of their name; of vertices v<i> beyond the last row of labels, that of the last."""
    last = labels.agg(F.max_by("label", F.try_to_number(F.substring("name", 2, 20), F.lit("99999999999999999")))).first()[0]
    return coordinates.join(labels, "name", "left").withColumn("label", F.coalesce("label", F.lit(last)))


def utc(time: Column) -> Column:
    """YYYY/MM/DD H:MM UTC, hours without a leading zero."""
    return F.concat(F.date_format(time, "yyyy/MM/dd H:mm"), F.lit(" UTC"))


def name_order() -> list[Column]:
    """Shorter names first, equal lengths by bytes."""
    return [F.octet_length("name"), F.col("name")]


def by_name(df: DataFrame) -> DataFrame:
    return df.orderBy(*name_order())


def _lines(df: DataFrame, columns: list[str]) -> DataFrame:
    parts = []
    for c in columns:
        kind = dict(df.dtypes)[c]
        parts.append(F.array_join(F.transform(c, lambda x: F.format_string("%.12g", x)), " ") if kind == "array<double>" else F.format_string("%.12g", F.col(c)) if kind == "double" else F.col(c).cast("string"))
    return df.select(F.concat_ws("  ", *parts).alias("value"))


def _comments(spark: SparkSession, lines: list[str]) -> DataFrame:
    return spark.createDataFrame([(f"# {x}".rstrip(),) for x in lines], "value string").coalesce(1)


def write_table(df: DataFrame, path: str, columns: list[str] | None = None, header: str | None = None, footer: str = "") -> None:
    """A folder of text in df's order, whose files by name, one after another, are the text; lines of header and footer begin with #."""
    columns = columns or df.columns
    if header is not None:
        spark = df.sparkSession
        whole = _comments(spark, [*header.splitlines(), "  ".join(columns)]).union(_lines(df, columns))
        (whole.union(_comments(spark, footer.splitlines())) if footer else whole).write.mode("overwrite").text(path)
    else:
        _lines(df, columns).write.mode("overwrite").text(path)


RULE = "=~" * 40


def coordinates_header(vertices: DataFrame, dim: int, beta: float, mu: float, about: dict[str, str] | None = None) -> str:
    """Times, sources and parameters; beta is in the ninth line, mu in the tenth."""
    n, low, big = vertices.agg(F.count("*"), F.min("kappa"), F.max_by("hyp_rad", -F.col("kappa"))).first()
    about = {"Embedding started at": "", "Ended at": "", "Elapsed time": "", "Edgelist file": ""} | (about or {})
    numbers = {"nb. vertices": n, "beta": beta, "mu": mu, f"radius_S{dim}": G.radius(dim, n) if n else 0.0, f"radius_H{dim + 1}": big, "kappa_min": low, "dimension": dim}
    lines = [RULE, *(f"{k}: {v}" for k, v in list(about.items())[:4]), "", "Parameters", *(f"  - {k}: {v}" for k, v in numbers.items())]
    return "\n".join([*lines, *(f"{k}: {v}" for k, v in list(about.items())[4:]), RULE])


def write_coordinates(vertices: DataFrame, path: str, dim: int, beta: float, mu: float, raw: bool = False, about: dict[str, str] | None = None, options: dict | None = None) -> None:
    """Coordinates by name, options in the footer; raw: without names and comments."""
    place = ["theta", "hyp_rad"] if dim == 1 else ["hyp_rad", "pos"]
    if raw:
        write_table(vertices.orderBy("vid"), path, ["kappa", "theta", "hyp_rad"] if dim == 1 else ["kappa", "pos"])
    else:
        write_table(by_name(vertices), path, ["name", "kappa", *place], coordinates_header(vertices, dim, beta, mu, about), "\n".join([RULE, "Internal parameters and options", *(f"  {k} {v}" for k, v in sorted((options or {}).items())), RULE]))


def write_edges(edges: DataFrame, vertices: DataFrame, path: str) -> None:
    named = edges.join(vertices.select(F.col("vid").alias("src"), F.col("name").alias("name1")), "src").join(vertices.select(F.col("vid").alias("dst"), F.col("name").alias("name2")), "dst")
    write_table(named, path, ["name1", "name2"])
