"""Schemas and fixed values of the attendance-sheet model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# Field names, codes, severities, titles and labels.
DAY_FIELDS = ["prog_entrata", "prog_uscita", "eff_entrata", "eff_uscita", "ore_dichiarate", "assenza_alunno", "assenza_operatore", "firma", "note"]
HEADER_FIELDS = [
    "anno_scolastico", "lotto", "municipalita", "ente", "istituto", "operatore", "alunno", "mese", "anno", "ore_pei",
    "sostituzione", "data_compilazione", "firma_coordinatore", "timbro_referente", "totale_mensile_dichiarato",
]
HOUR_FIELDS = ["prog_entrata", "prog_uscita", "eff_entrata", "eff_uscita", "ore_dichiarate"]
HEADER_HOUR_FIELDS = ["totale_mensile_dichiarato"]
SEVERITIES = ["errore", "attenzione", "info"]
CODES = [
    ("E01_ORE_NON_COERENTI", "errore", "ore non coerenti con l'orario"),
    ("E02_TOTALE_MENSILE_DIVERSO", "errore", "totale mensile diverso dalla somma"),
    ("E03_ORARIO_NON_VALIDO", "errore", "orario non valido"),
    ("E04_GIORNO_INESISTENTE", "errore", "giorno inesistente nel mese"),
    ("E05_CAMPO_ILLEGGIBILE", "errore", "campo illeggibile"),
    ("E06_NON_FOGLIO_FIRMA", "errore", "non è un foglio firma"),
    ("W01_FIRMA_MANCANTE", "attenzione", "firma operatore mancante"),
    ("W02_ORE_SENZA_ORARIO", "attenzione", "ore senza orario effettivo"),
    ("W03_GIORNO_FESTIVO", "attenzione", "prestazione in giorno non lavorativo"),
    ("W04_CAMPO_INCERTO", "attenzione", "lettura incerta"),
    ("W05_ASSENZA_OPERATORE_CON_ORE", "attenzione", "assenza operatore con ore"),
    ("W06_ORE_PEI_SUPERATE", "attenzione", "ore PEI superate"),
    ("W07_INTESTAZIONE_INCOMPLETA", "attenzione", "intestazione incompleta"),
    ("W08_FIRMA_COORDINATORE_MANCANTE", "attenzione", "firma coordinatore mancante"),
    ("W09_TIMBRO_REFERENTE_MANCANTE", "attenzione", "timbro referente mancante"),
    ("W10_TOTALE_MENSILE_ASSENTE", "attenzione", "totale mensile assente"),
    ("W11_DOPPIA_ASSENZA", "attenzione", "doppia assenza"),
    ("W12_ORE_NON_INDICATE", "attenzione", "ore non indicate"),
    ("W13_POSSIBILE_DUPLICATO", "attenzione", "possibile foglio duplicato"),
    ("W14_GRIGLIA_INCERTA", "attenzione", "griglia incerta"),
    ("I01_ASSENZA_ALUNNO", "info", "assenza alunno"),
    ("I02_ASSENZA_OPERATORE", "info", "assenza operatore"),
    ("I03_ORARIO_DIVERSO", "info", "orario diverso dal programmato"),
    ("I04_ORE_SENZA_PROGRAMMATO", "info", "orario senza programmato"),
    ("I05_NON_SVOLTO", "info", "prestazione non svolta"),
    ("I06_PAGINA_RADDRIZZATA", "info", "pagina raddrizzata automaticamente"),
]
LABELS = {
    "giorno": "Giorno", "prog_entrata": "Entrata programmata", "prog_uscita": "Uscita programmata", "eff_entrata": "Entrata effettiva",
    "eff_uscita": "Uscita effettiva", "ore_dichiarate": "Tot. ore effettive", "assenza_alunno": "Assenza alunno",
    "assenza_operatore": "Assenza operatore", "firma": "Firma operatore", "note": "Note", "trattino_effettivo": "Trattino negli orari effettivi",
    "anno_scolastico": "Anno scolastico", "lotto": "Lotto", "municipalita": "Municipalità", "ente": "Ente", "istituto": "Istituto scolastico",
    "operatore": "Operatore", "alunno": "Alunno", "mese": "Mese di riferimento", "anno": "Anno di riferimento", "ore_pei": "Ore da PEI",
    "sostituzione": "Sostituzione", "data_compilazione": "Data di compilazione", "firma_coordinatore": "Firma coordinatore dell'ente",
    "timbro_referente": "Timbro e firma referente scolastico", "totale_mensile_dichiarato": "Totale ore effettive mensili",
}
TOLERANCE = "0.01"
MAX_DAY_HOURS, MAX_WEEK_HOURS, MAX_MONTH_HOURS = 24, 60, 744
# End of fixed values.

CODE = {c.split("_")[0]: c for c, _, _ in CODES}
SEVERITY = {c: s for c, s, _ in CODES}

DAY_ROW = T.StructType([
    T.StructField("giorno", T.IntegerType()),
    *(T.StructField(n, T.StringType()) for n in ("prog_entrata", "prog_uscita", "eff_entrata", "eff_uscita")),
    T.StructField("ore_dichiarate", T.DecimalType(9, 4)),
    *(T.StructField(n, T.BooleanType()) for n in ("assenza_alunno", "assenza_operatore", "firma")),
    T.StructField("note", T.StringType()),
    T.StructField("trattino_effettivo", T.BooleanType()),
    T.StructField("incerti", T.ArrayType(T.StringType())),
    T.StructField("illeggibili", T.ArrayType(T.StringType())),
    T.StructField("confidenza", T.MapType(T.StringType(), T.DoubleType())),
])
HEADER = T.StructType([
    *(T.StructField(n, T.StringType()) for n in ("anno_scolastico", "lotto", "municipalita", "ente", "istituto", "operatore", "alunno")),
    T.StructField("mese", T.IntegerType()), T.StructField("anno", T.IntegerType()),
    T.StructField("ore_pei", T.DecimalType(9, 4)),
    T.StructField("sostituzione", T.StringType()), T.StructField("data_compilazione", T.StringType()),
    T.StructField("firma_coordinatore", T.BooleanType()), T.StructField("timbro_referente", T.BooleanType()),
    T.StructField("totale_mensile_dichiarato", T.DecimalType(9, 4)),
    T.StructField("incerti", T.ArrayType(T.StringType())), T.StructField("illeggibili", T.ArrayType(T.StringType())),
])
FINDING = T.StructType([
    T.StructField("codice", T.StringType()), T.StructField("gravita", T.StringType()), T.StructField("giorno", T.IntegerType()),
    T.StructField("campo", T.StringType()), T.StructField("valore_letto", T.StringType()), T.StructField("valore_atteso", T.StringType()),
])
USAGE = T.StructType([T.StructField("input_tokens", T.LongType()), T.StructField("output_tokens", T.LongType()), T.StructField("cost_usd", T.DoubleType()), T.StructField("seconds", T.DoubleType())])
SHEET = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("source_file", T.StringType()), T.StructField("source_sha256", T.StringType()),
    T.StructField("source_page", T.IntegerType()), T.StructField("page_count", T.IntegerType()),
    T.StructField("created_at", T.StringType()), T.StructField("updated_at", T.StringType()), T.StructField("status", T.StringType()),
    T.StructField("is_foglio_firma", T.BooleanType()), T.StructField("user_verified", T.BooleanType()),
    T.StructField("engine", T.StringType()), T.StructField("model", T.StringType()), T.StructField("error", T.StringType()),
    T.StructField("ocr_notes", T.StringType()), T.StructField("confidence", T.DoubleType()),
    T.StructField("header", HEADER), T.StructField("rows", T.ArrayType(DAY_ROW)), T.StructField("usage", USAGE),
    T.StructField("avvisi", T.ArrayType(FINDING)), T.StructField("user_edited", T.ArrayType(T.StringType())),
    T.StructField("ocr_originali", T.MapType(T.StringType(), T.StringType())),
])


def codes(spark: SparkSession) -> DataFrame:
    """The rule catalogue: codice, gravita, titolo, ordine."""
    return spark.createDataFrame([(*c, k) for k, c in enumerate(CODES)], "codice string, gravita string, titolo string, ordine int")


def labels(spark: SparkSession) -> DataFrame:
    """Field labels: campo, etichetta, ordine."""
    return spark.createDataFrame([(k, v, n) for n, (k, v) in enumerate(LABELS.items())], "campo string, etichetta string, ordine int")
