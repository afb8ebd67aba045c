"""Readers that bring labelled text, claims and predictions into a common shape."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions import fixed
from ..operators import sampling
from ..operators.sampling import factorize_labels
from . import segments
from .shared import stored

SPLITS = ("train", "dev", "test")
CSV_OPTIONS = {"header": True, "multiLine": True, "quote": '"', "escape": '"'}


def _found(read: Callable[[], DataFrame]) -> DataFrame | None:
    """What ``read`` returns, or None if the path does not exist."""
    try:
        return read()
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def _all_splits(parts: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    out = None
    for split, df in parts:
        tagged = df.withColumn("split", F.lit(split))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def narrowest_label(df: DataFrame, label_col: str = "label") -> DataFrame:
    """A string label column as int or bigint if all its values are whole numbers of up to 9 or 18 digits, as decimal(38,0) up to 38,
    as double if all are numbers that a double holds (15 digits at most), else as it is.

    One aggregate job over the column decides, when this is called, so no digit is lost.
    """
    text = F.btrim(F.col(label_col))
    number = text.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$")
    digits = F.length(F.regexp_replace(F.regexp_replace(text, "[eE].*$", ""), "[^0-9]", ""))
    whole = [F.bool_and(text.rlike(f"^[+-]?[0-9]{{1,{n}}}$")) for n in (9, 18, 38)]
    fits = df.agg(*whole, F.bool_and(number & (digits <= 15))).first()
    kind = next((k for k, fit in zip(("int", "bigint", "decimal(38,0)", "double"), fits) if fit), None)
    return df.withColumn(label_col, text.cast(kind)) if kind else df


def read_csv_file(spark: SparkSession, path: str, types: dict[str, str] | None = None, multi_line: bool | str = True) -> DataFrame | None:
    """A CSV file (or folder of them) with text and label; None unless it exists and has both. Columns are strings except those in ``types``.

    Quoted texts may contain line breaks, which makes one task of each file; without them, ``multi_line=False`` splits files. With
    ``multi_line="split"`` many tasks read a file although texts contain line breaks: a pass over the quotes finds where records
    end (``segments.csv_records``). Quotes then have to stand around whole fields, and all files need the same header.
    """
    options = CSV_OPTIONS | {"multiLine": bool(multi_line)}
    header = _found(lambda: spark.read.options(**options).csv(path))
    if header is None or not {"text", "label"} <= set(header.columns):
        return None
    schema = ", ".join(f"`{c}` {(types or {}).get(c, 'string')}" for c in header.columns)
    if multi_line != "split":
        return spark.read.schema(schema).options(**options).csv(path)
    # the parser of single records turns \r\n into \n inside quotes, so \r travels as two private characters
    mark, one, two = (F.lit(c) for c in "\ue000\ue001\ue002")
    kept = F.replace(F.replace(F.col("value"), mark, F.concat(mark, one)), F.lit("\r"), F.concat(mark, two))
    rows = segments.csv_records(spark, path).filter("record > 0").select(F.from_csv(kept, schema, {"quote": '"', "escape": '"'}).alias("row")).select("row.*")
    back = lambda c: F.replace(F.replace(F.col(c), F.concat(mark, two), F.lit("\r")), F.concat(mark, one), mark)
    return rows.select(*[back(f"`{f.name}`").alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`") for f in rows.schema.fields])


def read_csv_splits(spark: SparkSession, folder: str, types: dict[str, str] | None = None, multi_line: bool | str = True) -> DataFrame | None:
    """train.csv, dev.csv and test.csv (files or folders of files) as one table with a split column.

    None unless all three exist and hold text and label. Labels stay what they are in the files: whole numbers,
    numbers or text (``narrowest_label``), unless ``types`` names their type.
    """
    parts = [(s, read_csv_file(spark, f"{folder}/{s}.csv", types, multi_line)) for s in SPLITS]
    if any(df is None for _, df in parts):
        return None
    out = _all_splits(parts)
    return out if "label" in (types or {}) else narrowest_label(out)


def claims(df: DataFrame) -> DataFrame:
    """Claim rows to (text, label); rows whose label is not one of the known ones are dropped."""
    codes = df.sparkSession.createDataFrame(list(fixed.CLAIM_LABELS.items()), "label string, code int")
    return df.join(F.broadcast(codes), "label").select(  # three rows
        *[c for c in df.columns if c not in ("claim", "label")],
        F.coalesce("claim", F.lit("")).alias("text"),
        F.col("code").alias("label"),
    )


def read_jsonl_claims(
    spark: SparkSession,
    folder: str,
    files: Sequence[str] = ("train", "paper_dev", "paper_test"),
    columns: str = "claim string, label string",
    mode: str = "FAILFAST",
) -> DataFrame | None:
    """Claims in JSON lines, one file (or folder) per split; None unless all exist. A broken line is an error; ``mode="DROPMALFORMED"`` skips it."""
    parts = [_found(lambda name=name: spark.read.schema(columns).option("mode", mode).json(f"{folder}/{name}.jsonl")) for name in files]
    if any(df is None for df in parts):
        return None
    return _all_splits([(s, claims(df)) for s, df in zip(SPLITS, parts)])


def quarantine_jsonl(spark: SparkSession, path: str, columns: str) -> tuple[DataFrame, DataFrame]:
    """(rows, errors) of a JSON-lines file or folder: each line is in one of them, blank lines in none.

    ``errors``: (file, line, value), the file, the number of the line in it from 1, and its text, for lines that are no JSON object or do not fit
    ``columns``. Many tasks read a file; line numbers are running sums over its blocks. Lines are stored once.
    """
    lines = stored(segments.segments(spark, path, "\n"), "lines")
    lines = segments.running(lines, line=F.lit(1)).withColumn("value", F.regexp_replace("value", "\r$", ""))
    lines = lines.filter(F.trim(F.replace(F.col("value"), F.lit("\t"), F.lit(" "))) != "")
    parsed = lines.withColumn("row", F.from_json("value", f"{columns}, _broken string", {"columnNameOfCorruptRecord": "_broken"}))
    broken = F.col("row").isNull() | F.col("row._broken").isNotNull()
    names = [c for c in parsed.select("row.*").columns if c != "_broken"]
    rows = parsed.filter(~broken).select(*[F.col(f"row.`{c}`").alias(c) for c in names])
    return rows, parsed.filter(broken).select("file", (F.col("line") + 1).alias("line"), "value")


def read_jsonl_claims_kept(
    spark: SparkSession, folder: str, files: Sequence[str] = ("train", "paper_dev", "paper_test"), columns: str = "claim string, label string"
) -> tuple[DataFrame, DataFrame] | None:
    """``read_jsonl_claims`` with broken lines set apart: (claims, errors), errors being (split, file, line, value)."""
    if any(_found(lambda name=name: spark.read.text(f"{folder}/{name}.jsonl")) is None for name in files):
        return None
    parts = [quarantine_jsonl(spark, f"{folder}/{name}.jsonl", columns) for name in files]
    good = _all_splits([(s, claims(rows)) for s, (rows, _) in zip(SPLITS, parts)])
    return good, _all_splits([(s, errors) for s, (_, errors) in zip(SPLITS, parts)])


def pick_text_column(df: DataFrame, candidates: Sequence[str] = tuple(fixed.TOXICITY_TEXT_COLUMNS)) -> str:
    """The first of the source's text columns that there is, else the first string column, else the first column."""
    for name in candidates:
        if name in df.columns:
            return name
    strings = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return strings[0] if strings else df.columns[0]


def toxicity_label(df: DataFrame) -> Column:
    """Label rule chosen from the columns present: a ready label, toxic, any toxicity column, a target score."""
    if "label" in df.columns:
        return F.col("label")
    if "toxic" in df.columns:
        return (F.col("toxic") > 0).cast("int")
    marks = [c for c in fixed.TOXICITY_COLUMNS if c in df.columns]
    if marks:
        total = F.coalesce(F.col(marks[0]), F.lit(0))
        for c in marks[1:]:
            total = total + F.coalesce(F.col(c), F.lit(0))
        return (total > 0).cast("int")
    if "target" in df.columns:
        return F.coalesce((F.col("target") >= 0.5).cast("int"), F.lit(0))
    raise ValueError("Could not determine label column")


def normalize_label_source(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Toxicity sources of any layout to (text, label), plus ``keep``."""
    return df.select(*keep, F.col(pick_text_column(df)).alias("text"), toxicity_label(df).cast("int").alias("label"))


def normalize_crisis_source(df: DataFrame, id_col: str, keep: Sequence[str] = ()) -> DataFrame:
    """Crisis sources to (text, label); string labels become codes in order of first appearance."""
    names = [c for c in fixed.LABEL_COLUMNS if c in df.columns]
    if not names:
        raise ValueError("Could not find label column")
    name, text = names[0], pick_text_column(df, fixed.CRISIS_TEXT_COLUMNS)
    if isinstance(df.schema[name].dataType, T.StringType):
        coded = factorize_labels(df.select(*{*keep, id_col, text, name}), name, id_col, "_code")
        return coded.select(*keep, F.col(text).alias("text"), F.col("_code").cast("int").alias("label"))
    return df.select(*keep, F.col(text).alias("text"), F.col(name).cast("int").alias("label"))


def normalize_review_source(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Review sources to (text, label), plus ``keep``."""
    return df.select(*keep, F.col(pick_text_column(df, fixed.REVIEW_TEXT_COLUMNS)).alias("text"), F.col("label").cast("int").alias("label"))


#: How a raw table of a data set becomes (text, label), and where its dev split is cut from if it has none.
RAW_SOURCES = {
    "imdb": (lambda df, i: normalize_review_source(df, (i, "split")), "test"),
    "jigsaw": (lambda df, i: normalize_label_source(df, (i, "split")), "train"),
    **{name: (lambda df, i: normalize_crisis_source(df, i, (i, "split")), "train") for name in ("crisisbench", "crisisbench_humanitarian", "crisisbench_informativeness")},
}


def load_dataset(spark: SparkSession, name: str, root: str, id_col: str = "id", **options) -> DataFrame:
    """Labelled text of a data set by name, from the first of these that ``root/<name>`` has:

    for jigsaw a stratified sample, sample.csv, nearly all of which becomes test (``sampling.mini_splits``); train.csv,
    dev.csv and test.csv; a parquet table ``raw`` in the source's own columns with ``id_col`` and split, whose columns are
    normalised and whose missing splits are cut by the data set's rule. Claims (fever) come as JSON lines.
    """
    folder = f"{root}/{name}"
    if name == "fever":
        found = read_jsonl_claims(spark, folder, **options)
    elif name not in RAW_SOURCES:
        raise ValueError(f"Unknown dataset: {name}")
    else:
        found = None
        sample = read_csv_file(spark, f"{folder}/sample.csv", **options) if name == "jigsaw" else None
        if sample is not None and id_col in sample.columns:
            found = sampling.mini_splits(sample if "label" in (options.get("types") or {}) else narrowest_label(sample), id_col)
        if found is None:
            found = read_csv_splits(spark, folder, **options)
        if found is None:
            raw = _found(lambda: spark.read.parquet(f"{folder}/raw"))
            if raw is not None:
                normalize, dev_from = RAW_SOURCES[name]
                found = sampling.split_from_existing(normalize(raw, id_col), "split", id_col, "label", dev_from=dev_from)
    if found is None:
        raise FileNotFoundError(f"no complete set of files for {name} under {root}")
    return found


def dataset_registry(spark: SparkSession) -> DataFrame:
    """The known data sets, one row each."""
    rows = [
        (key, d["name"], d["task"], d["classes"], *[(d["split_ratios"] or {}).get(s) for s in SPLITS])
        for key, d in fixed.DATASETS.items()
    ]
    return spark.createDataFrame(rows, "dataset string, name string, task string, classes array<string>, train double, dev double, test double")


PREDICTION_FIELDS = {
    "example_id": "bigint",
    "text": "string",
    "gold_label": "int",
    "predicted_label": "int",
    "logits": "array<double>",
    "probabilities": "array<double>",
    "entropy": "double",
    "max_prob": "double",
    "correct": "boolean",
}


def load_predictions(
    spark: SparkSession, path: str, form: str = "parquet", fields: Sequence[str] = tuple(PREDICTION_FIELDS), multi_line: bool = False
) -> DataFrame:
    """Saved predictions as rows.

    ``form`` "columns" reads JSON objects that hold parallel lists (pass the fields present): one object per line, or
    with ``multi_line`` one object per file, spread over its lines; an object is one row before it becomes many. "lists" reads files that
    are one such object of any size: many tasks read its elements, which meet by their places (``segments.list_elements``); fields that are missing
    and lists that are shorter give NULL. "parquet" reads rows as they are.
    """
    if form == "parquet":
        return spark.read.parquet(path).select(*fields)
    if form == "lists":
        cells = segments.list_elements(spark, path).filter(F.col("field").isin(list(fields)))
        rows = cells.groupBy("file", "at").agg(*[F.max(F.when(F.col("field") == f, F.concat(F.lit("["), "value", F.lit("]")))).alias(f) for f in fields])
        return rows.select(*[F.from_json(f, f"array<{PREDICTION_FIELDS[f]}>", {"mode": "FAILFAST"})[0].alias(f) for f in fields])
    if form != "columns":
        raise ValueError(f"Unknown form: {form}")
    schema = ", ".join(f"{f} array<{PREDICTION_FIELDS[f]}>" for f in fields)
    lists = spark.read.schema(schema).option("multiLine", multi_line).option("mode", "FAILFAST").json(path)
    return lists.select(F.inline(F.arrays_zip(*fields)))


def test_limit(df: DataFrame, n: int = 50, id_col: str = "id") -> DataFrame:
    """First ``n`` rows by key, for a trial run."""
    return df.orderBy(id_col).limit(n)


