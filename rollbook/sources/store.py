"""Sources: the document store, side files, the registry file, lenient reader output, and file kinds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException
from pyspark.sql import types as T

from ..functions.values import clean, enough_letters, field_list, hours, month, name_key, year
from ..plans.model import DAY_FIELDS, HEADER_FIELDS, MAX_MONTH_HOURS, MAX_WEEK_HOURS, SHEET

ID = r"([0-9a-f]{12})/[^/]*$"


def documents(spark: SparkSession, root: str) -> DataFrame:
    """All sheets of <root>/<12 hex>/doc.json. Unreadable files are skipped; the folder's name is the id."""
    schema = T.StructType([*SHEET.fields, T.StructField("_corrupt_record", T.StringType())])
    raw = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(f"{root}/*/doc.json")
    folder = F.nullif(F.regexp_extract(F.col("_metadata.file_path"), ID, 1), F.lit(""))
    return raw.withColumn("_folder", folder).where("_corrupt_record is null and _folder is not null").withColumn("id", F.col("_folder")).select(SHEET.names)


def grids(spark: SparkSession, root: str) -> DataFrame:
    """(doc_id, col_x, row_y, row_quality) of valid grid side files: 11 columns, 32 lines, 31 rows."""
    schema = "col_x array<int>, row_y array<int>, row_quality array<double>"
    raw = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(f"{root}/*/grid.json")
    out = raw.select(F.regexp_extract("_metadata.file_path", ID, 1).alias("doc_id"), "col_x", "row_y", "row_quality")
    return out.where((F.size("col_x") == 11) & (F.size("row_y") == 32) & (F.size("row_quality") == 31))


def preparations(spark: SparkSession, root: str) -> DataFrame:
    """(doc_id, rotation, skew, perspective, mesh) of page-preparation side files."""
    raw = spark.read.schema("rotation int, skew double, perspective boolean, mesh boolean").option("multiLine", True).option("mode", "PERMISSIVE").json(f"{root}/*/prep.json")
    return raw.select(F.regexp_extract("_metadata.file_path", ID, 1).alias("doc_id"), "rotation", "skew", "perspective", "mesh")


def corrections() -> Column:
    """What was done to a page, in words; empty if nothing."""
    rotated = F.when(F.col("rotation") == 180, "capovolta").when(F.col("rotation").isin(90, 270), "ruotata")
    return F.array_compact(F.array(rotated, F.when(F.abs("skew") >= 1, "inclinata"), F.when(F.col("perspective"), "in prospettiva"), F.when(F.col("mesh"), "foglio incurvato")))


def registry(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The registry file as its three tables; what can't be read is left out."""
    entry = T.StructType.fromDDL("valore string, conteggio int, ultimo_uso string, manuale boolean")
    link = T.StructType.fromDDL("operatore string, alunno string, istituto string, ente string, lotto string, municipalita string, ore_pei double, conteggio int, ultimo_uso string")
    doc = T.StructType.fromDDL("campi map<string,string>, associazione string, aggiornato string")
    schema = T.StructType([T.StructField("campi", T.MapType(T.StringType(), T.MapType(T.StringType(), entry))), T.StructField("associazioni", T.MapType(T.StringType(), link)), T.StructField("documenti", T.MapType(T.StringType(), doc))])
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("r"))
    told = raw.select(F.explode("r.campi").alias("campo", "m")).select("campo", F.explode("m").alias("k", "v")).select("campo", "v.*").where(enough_letters(F.col("valore")))
    # keys follow from the values, whatever the file says; of two entries that meet, the later use is kept
    sane = told.select("campo", name_key(F.col("valore")).alias("chiave"), clean(F.col("valore")).alias("valore"), F.greatest(F.lit(0), F.coalesce("conteggio", F.lit(0))).alias("conteggio"), F.coalesce("ultimo_uso", F.lit("")).alias("ultimo_uso"), F.coalesce("manuale", F.lit(False)).alias("manuale"))
    rest = F.struct("valore", "conteggio", "ultimo_uso", "manuale")
    values = sane.groupBy("campo", "chiave").agg(F.max_by(rest, F.struct("ultimo_uso", "conteggio", "valore")).alias("v")).select("campo", "chiave", "v.*")
    links = raw.select(F.explode("r.associazioni").alias("k", "v")).select("k", "v.*").where(clean(F.col("operatore")).isNotNull())
    docs = raw.select(F.explode("r.documenti").alias("doc_id", "v")).select("doc_id", F.explode("v.campi").alias("campo", "chiave"), "v.associazione", "v.aggiornato")
    return values, links, docs


_TEXT_ROW = T.StructType([T.StructField("giorno", T.StringType()), *(T.StructField(f, T.StringType()) for f in DAY_FIELDS), T.StructField("incerti", T.ArrayType(T.StringType())), T.StructField("illeggibili", T.ArrayType(T.StringType()))])
_TEXT_HEAD = T.StructType([*(T.StructField(f, T.StringType()) for f in HEADER_FIELDS), T.StructField("incerti", T.ArrayType(T.StringType())), T.StructField("illeggibili", T.ArrayType(T.StringType()))])
EXTRACTION = T.StructType([T.StructField("header", _TEXT_HEAD), T.StructField("rows", T.ArrayType(_TEXT_ROW)), T.StructField("is_foglio_firma", T.BooleanType())])


def _truth(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c)).isin("1", "true", "si", "sì", "yes", "x", "vero"), F.lit(False))


def extraction(texts: DataFrame, body: str = "body", wanted: list[int] | None = None) -> DataFrame:
    """Reader output (id, body as JSON) as sheets: lenient about types, empty texts are null, illegible fields have no
    value. With ``wanted`` days, rows without a day number take the day of their place if there are as many as wanted;
    of several rows for a day a filled one wins over an empty one, then the first."""
    parsed = texts.withColumn("x", F.from_json(body, EXTRACTION))
    days = F.array(*map(F.lit, wanted or range(1, 32)))

    def typed(r: Column, place: Column, count: Column) -> Column:
        day = F.coalesce(r["giorno"].try_cast("int"), F.when(count == F.size(days), F.get(days, place)))
        ill = field_list(r["illeggibili"], DAY_FIELDS)
        own = lambda f, v: F.when(~F.array_contains(ill, f), v)
        texts_ = [own(f, clean(r[f], 200)).alias(f) for f in DAY_FIELDS[:4]]
        marks = [F.coalesce(own(f, _truth(r[f])), F.lit(False)).alias(f) for f in DAY_FIELDS[5:8]]
        doubt = F.array_union(F.array_except(field_list(r["incerti"], DAY_FIELDS), ill), F.array_intersect(ill, F.array(*map(F.lit, DAY_FIELDS[5:8]))))
        return F.struct(day.alias("giorno"), *texts_, own("ore_dichiarate", hours(r["ore_dichiarate"])).cast("decimal(9,4)").alias("ore_dichiarate"), *marks, own("note", clean(r["note"], 500)).alias("note"), F.lit(False).alias("trattino_effettivo"), doubt.alias("incerti"), F.array_except(ill, F.array(*map(F.lit, DAY_FIELDS[5:8]))).alias("illeggibili"))

    rows = F.transform("x.rows", lambda r, i: typed(r, i, F.size("x.rows")))
    filled = lambda r: (F.coalesce(r["prog_entrata"], r["prog_uscita"], r["eff_entrata"], r["eff_uscita"], r["note"]).isNotNull() | r["ore_dichiarate"].isNotNull() | r["assenza_alunno"] | r["assenza_operatore"] | r["firma"]).cast("int")
    one = lambda g: F.get(F.array_sort(F.filter("r", lambda r: r["giorno"] == g), lambda a, b: filled(b) - filled(a)), F.lit(0))
    head = F.col("x.header")
    h_ill = field_list(head["illeggibili"], HEADER_FIELDS)
    own = lambda f, v: F.when(~F.array_contains(h_ill, f), v).alias(f)
    header = F.struct(
        *(own(f, clean(head[f], 200)) for f in HEADER_FIELDS[:7]), own("mese", month(head["mese"])), own("anno", year(head["anno"])), own("ore_pei", hours(head["ore_pei"], MAX_WEEK_HOURS).cast("decimal(9,4)")),
        own("sostituzione", F.upper(clean(head["sostituzione"]))), own("data_compilazione", clean(head["data_compilazione"])), *(F.coalesce(_truth(head[f]), F.lit(False)).alias(f) for f in HEADER_FIELDS[12:14]),
        own("totale_mensile_dichiarato", hours(head["totale_mensile_dichiarato"], MAX_MONTH_HOURS).cast("decimal(9,4)")), F.array_except(field_list(head["incerti"], HEADER_FIELDS), h_ill).alias("incerti"), h_ill.alias("illeggibili"),
    )
    return parsed.withColumn("r", F.coalesce(rows, F.array().cast("array<struct<giorno:int,prog_entrata:string,prog_uscita:string,eff_entrata:string,eff_uscita:string,ore_dichiarate:decimal(9,4),assenza_alunno:boolean,assenza_operatore:boolean,firma:boolean,note:string,trattino_effettivo:boolean,incerti:array<string>,illeggibili:array<string>>>"))).select(
        "id", header.alias("header"), F.filter(F.transform(days, one), lambda x: x.isNotNull()).alias("rows"), F.coalesce("x.is_foglio_firma", F.lit(True)).alias("is_foglio_firma")
    )


# First bytes of the file kinds.
KINDS = [("pdf", "25504446"), ("png", "89504E470D0A1A0A"), ("jpeg", "FFD8FF"), ("tiff", "49492A00"), ("tiff", "4D4D002A"), ("bmp", "424D"), ("gif", "474946383"), ("webp", "52494646")]
EXTENSIONS = {"pdf": "pdf", "png": "png", "jpg": "jpeg", "jpeg": "jpeg", "tif": "tiff", "tiff": "tiff", "bmp": "bmp", "gif": "gif", "webp": "webp"}
# End of fixed values.


def file_kind(content: Column, path: Column) -> Column:
    """A file's kind by its first bytes, else by its extension, else null."""
    head = F.hex(F.substring(content, 1, 12))
    by_head = F.coalesce(*(F.when(head.startswith(magic), k) for k, magic in KINDS))
    suffix = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.coalesce(by_head, *(F.when(suffix == e, k) for e, k in EXTENSIONS.items()))


#: Files of one upload at most, and bytes of a file.
MOST_FILES, MOST_BYTES = 5000, 200 << 20


def uploads(spark: SparkSession, folder: str, known: DataFrame | None = None) -> DataFrame:
    """Landed files with their kind and digest; ``error`` says why one can't be taken, ``known_as`` which sheet has its first page already
    (known: doc_id, source_sha256). More files than an upload may have are refused as a whole, before any is read."""
    paths = spark.read.format("binaryFile").load(folder).select("path")
    if paths.limit(MOST_FILES + 1).count() > MOST_FILES:
        raise ValueError(f"an upload has {MOST_FILES} files at most")
    raw = spark.read.format("binaryFile").load(folder)
    kind = file_kind(F.col("content"), F.col("path"))
    error = F.when(F.col("length") == 0, "file vuoto").when(F.col("length") > MOST_BYTES, "file troppo grande").when(kind.isNull(), "formato non riconosciuto")
    out = raw.select("path", "length", F.sha2("content", 256).alias("source_sha256"), kind.alias("kind"), error.alias("error"))
    if known is None:
        return out
    first = known.groupBy("source_sha256").agg(F.min("doc_id").alias("known_as"))
    return out.join(first, "source_sha256", "left").withColumn("error", F.coalesce("error", F.when(F.col("known_as").isNotNull(), "già importato")))


def settings(spark: SparkSession, path: str, defaults: dict) -> dict:
    """A settings file (one JSON object) over the defaults, key by key: unknown keys and values of another kind are left out, and an
    unreadable file leaves the defaults. Numbers may be whole where the default isn't."""
    import json

    try:
        told = json.loads(spark.read.text(path, wholetext=True).first().value)
    except (ValueError, AttributeError, AnalysisException):
        return dict(defaults)

    def fits(value, default) -> bool:
        if isinstance(default, bool) or isinstance(value, bool):
            return isinstance(default, bool) and isinstance(value, bool)
        return default is None or isinstance(value, type(default)) or (isinstance(default, float) and isinstance(value, int))

    return defaults | {k: v for k, v in (told.items() if isinstance(told, dict) else ()) if k in defaults and fits(v, defaults[k])}
