"""Free texts of a sheet: names and notes, with how sure their reading is.

A note is compared with a vocabulary of words and phrases. The comparisons are made in Arrow batches, once for each
reading, and give its features; what becomes of the note is decided over the features as columns.
"""

from __future__ import annotations

import re
import unicodedata
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lexicons import PHRASES, SPELLINGS_104
from ..functions.values import degenerate_name, narrow

# Thresholds of names and notes, further words of notes, and words that are no note by themselves.
NAME_FLOOR, NAME_SURE = 0.12, 0.85
NOTE_SURE, PHRASE_SURE, PHRASE_ALIKE, WORD_ALIKE, NOTE_SNAP, PHRASE_LENGTH = 0.6, 0.85, 0.7, 0.8, 0.8, 0.2
SHORT, SHORT_SURE, SHORT_ALIKE, WIDE, ALONE = 4, 0.2, 0.5, 3.0, 0.3
READ_AS_LETTERS = str.maketrans("OQDILSB", "0001158")
FURTHER_WORDS = [
    "ALUNNO", "ALUNNA", "NON", "ERA", "PRESENTE", "ASSENZA", "ORE", "ORA", "ORARIO", "ENTRATA", "USCITA", "ANTICIPO", "ANTICIPATA", "RITARDO",
    "POSTICIPATA", "ISTITUTO", "SCUOLA", "CLASSE", "DOCENTI", "MEDICO", "CERTIFICATO", "CERTIFICAZIONE", "PROTOCOLLO", "RICHIESTA", "SERVIZIO",
    "SOSPENSIONE", "ATTIVITA", "DIDATTICA", "DIDATTICHE", "MANIFESTAZIONE", "INCONTRO", "GENITORI", "COLLOQUIO", "SUL", "SULLA", "DEL", "DELLA", "DELL",
    "DI", "DA", "AL", "ALLA", "IL", "LA", "LO", "PER", "CON", "SU", "NEL", "MATTINA", "POMERIGGIO", "GIORNO", "GIORNATA", "FESTIVITA", "SANTO", "PATRONO",
    "COMUNE", "CHIUSO", "CHIUSA", "RETRIBUITO", "RETRIBUITA", "MALATO", "MALATA", "LEGGE", "EVENTO", "TEATRO",
]
FUNCTION_WORDS = [
    "IL", "LA", "LO", "LE", "GLI", "I", "DI", "DA", "AL", "ALLA", "SUL", "SULLA", "DEL", "DELLA", "DELL", "PER", "CON", "SU", "NEL", "E", "A", "IN", "UN",
    "UNA",
]
# End of fixed values.
_FORMS = {re.sub(r"\s+", "", t): "104" for t in SPELLINGS_104} | {re.sub(r"\s+", "", p): p for p in PHRASES}
VOCABULARY = sorted({w for t in [*SPELLINGS_104, *PHRASES] for w in re.findall("[A-Z]{2,}", t)} | set(FURTHER_WORDS))
_KNOWN = frozenset(VOCABULARY)
_LETTERS = re.compile("[^A-Z0-9ÀÈÉÌÒÙ]")


def clean_name(c: Column) -> Column:
    """Upper case, only characters of names, no signs at the ends."""
    kept = F.regexp_replace(F.upper(narrow(c)), r"[^A-ZÀÈÉÌÒÙ0-9' .\-/]", " ")
    return F.regexp_replace(F.regexp_replace(kept, r"\s+", " "), r"^[ .\-/',]+|[ .\-/',]+$", "")


def name_field(text: Column, confidence: Column, sure: float = NAME_SURE, floor: float = NAME_FLOOR) -> Column:
    """A struct of valore, confidenza, incerto and illeggibile for a name's free reading: handwritten names stay in doubt unless read
    with conviction; without letters or digits, in a loop, or below the floor they are illegible."""
    name = clean_name(text)
    bad = text.isNull() | ~F.coalesce(name.rlike("[A-Z0-9ÀÈÉÌÒÙ]"), F.lit(False)) | F.coalesce(confidence < floor, F.lit(True)) | degenerate_name(text)
    return F.struct(F.when(~bad, name).alias("valore"), confidence.alias("confidenza"), (~bad & (confidence < sure)).alias("incerto"), bad.alias("illeggibile"))


def alike(a: str, b: str) -> float:
    """The ratio of matching blocks of two texts without their white space, in upper case."""
    x, y = (re.sub(r"\s+", "", unicodedata.normalize("NFKC", t)).upper() for t in (a, b))
    return SequenceMatcher(None, x, y).ratio() if x and y else 0.0


class Word:
    """A word of a note: known (a number, a word of the vocabulary or its abbreviation), mended to a known one, or strange."""

    def __init__(self, token: str):
        core = _LETTERS.sub("", token)
        plain = unicodedata.normalize("NFKD", core).encode("ascii", "ignore").decode()
        self.text, self.counts, self.plain = token, bool(core), re.sub("[^A-Z0-9]", "", token)
        short_for = token.endswith(".") and len(plain) >= 3 and any(w.startswith(plain) for w in VOCABULARY)
        self.known, self.mended = self.counts and (plain.isdigit() or plain in _KNOWN or short_for), False
        if self.counts and not self.known and len(plain) >= 4:
            score, best = max((alike(plain, w), w) for w in VOCABULARY if abs(len(w) - len(plain)) <= 2) if any(abs(len(w) - len(plain)) <= 2 for w in VOCABULARY) else (0.0, "")
            if score >= WORD_ALIKE:
                self.text, self.mended, self.plain = token.replace(core, best), True, best


def features(text: str, phrase: str | None) -> dict:
    """What the decision about a note's cleaned text needs; ``phrase`` is the constrained reading's best."""
    words = [Word(t) for t in text.split()]
    mended = " ".join(w.text for w in words)
    key = re.sub(r"\s+", "", mended)
    stray = re.sub(r"^[.'`\"-]{1,2}|[.,'`\"\-:;]{1,2}$", "", key)
    counted = [w for w in words if w.counts]
    size = len(key)
    near = [(alike(mended, form), -k, value) for k, (form, value) in enumerate(_FORMS.items()) if abs(len(form) - size) <= PHRASE_LENGTH * max(size, len(form))]
    score, _, snap = max(near, default=(0.0, 0, None))
    digits = re.sub("[^A-Z0-9]", "", text).translate(READ_AS_LETTERS)
    return {
        "testo": mended, "esatta": _FORMS.get(key, _FORMS.get(stray)), "corrette": sum(w.mended for w in counted), "tutte_note": bool(counted) and all(w.known for w in counted),
        "nel_vocabolario": bool(words) and all(w.plain in _KNOWN for w in words), "vuota": bool(words) and all(w.plain in FUNCTION_WORDS for w in words), "lettere": len(_LETTERS.sub("", mended)),
        "parole": len(counted), "simile": snap, "somiglianza": score, "al_lessico": alike(text, phrase) if phrase and text else 0.0, "cifre_al_lessico": alike(digits, phrase) if phrase else 0.0,
    }


_FEATURES = pa.struct([
    ("testo", pa.string()), ("esatta", pa.string()), ("corrette", pa.int32()), ("tutte_note", pa.bool_()), ("nel_vocabolario", pa.bool_()), ("vuota", pa.bool_()), ("lettere", pa.int32()),
    ("parole", pa.int32()), ("simile", pa.string()), ("somiglianza", pa.float64()), ("al_lessico", pa.float64()), ("cifre_al_lessico", pa.float64()),
])
_FEATURES_DDL = "testo string, esatta string, corrette int, tutte_note boolean, nel_vocabolario boolean, vuota boolean, lettere int, parole int, simile string, somiglianza double, al_lessico double, cifre_al_lessico double"


def note_fields(readings: DataFrame) -> DataFrame:
    """Readings of notes (doc_id, giorno, free_text, free_confidence, free_tokens, phrase, phrase_logprob, aspect) with valore, confidenza,
    incerto and illeggibile. A reading without text is illegible; a short one outside the vocabulary is a stray mark, which
    is ignored unless the crop is wide. Equal texts are compared with the vocabulary once."""
    text = clean_name(F.col("free_text"))
    dotted = F.concat(text, F.when((text != "") & F.rtrim("free_text").endswith("."), ".").otherwise(""))
    cleaned = readings.withColumn("t", F.coalesce(dotted, F.lit("")))
    schema = pa.schema([("t", pa.string()), ("phrase", pa.string()), ("x", _FEATURES)])

    def run(batches):
        for batch in batches:
            rows = [features(t, p) for t, p in zip(batch.column("t").to_pylist(), batch.column("phrase").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("t"), batch.column("phrase"), pa.array(rows, _FEATURES)], schema=schema)

    told = cleaned.select("t", F.col("phrase").cast("string").alias("phrase")).distinct().mapInArrow(run, f"t string, phrase string, x struct<{', '.join(p.replace(' ', ': ', 1) for p in _FEATURES_DDL.split(', '))}>")
    told = told.withColumnsRenamed({"t": "t2", "phrase": "p2"})
    joined = cleaned.join(told, (F.col("t") == F.col("t2")) & F.col("phrase").eqNullSafe(F.col("p2")))
    conf, has_phrase = F.col("free_confidence"), F.col("phrase").isNotNull()
    by_phrase = F.exp(F.least(F.lit(0.0), F.col("phrase_logprob")) / (F.greatest(F.lit(1), F.col("free_tokens")) + 1))
    empty, x = F.col("t") == "", lambda f: F.col(f"x.{f}")
    phrase_wins = has_phrase & ((x("al_lessico") >= PHRASE_ALIKE) | (empty & (by_phrase >= ALONE)))
    stray = (x("lettere") < SHORT) & ~((x("parole") > 0) & (x("corrette") == 0) & ~x("vuota") & x("nel_vocabolario"))
    offered = has_phrase & (by_phrase >= SHORT_SURE) & (F.greatest(x("al_lessico"), x("cifre_al_lessico")) >= SHORT_ALIKE)
    cases = [  # the first that holds: condition, value, confidence, uncertain, illegible
        (F.col("free_text").isNull(), None, None, False, True),
        (phrase_wins, F.col("phrase"), F.when(empty, by_phrase).otherwise(F.least(by_phrase, conf)), ~((x("al_lessico") >= PHRASE_SURE) & (by_phrase >= NOTE_SURE) & (conf >= NOTE_SURE)), False),
        (empty, None, conf, False, True),
        (x("esatta").isNotNull(), x("esatta"), conf, (x("corrette") > 0) | (conf < NOTE_SURE), False),
        (stray & offered, F.col("phrase"), by_phrase, True, False),
        (stray & F.coalesce(F.col("aspect") >= WIDE, F.lit(False)), None, conf, False, True),
        (stray, None, None, False, False),
        (x("simile").isNotNull() & (x("somiglianza") >= NOTE_SNAP), x("simile"), F.least(conf, x("somiglianza")), True, False),
        (F.lit(True), x("testo"), conf, ~(x("tutte_note") & (conf >= NOTE_SURE) & ~x("testo").rlike(r"\d") & ~x("vuota")), False),
    ]
    column = lambda v, kind: (v if isinstance(v, Column) else F.lit(v)).cast(kind)
    pick = lambda k, kind: F.coalesce(*(F.when(c[0], F.struct(column(c[k], kind).alias("v"))) for c in cases))["v"]
    return joined.select(*readings.columns, pick(1, "string").alias("valore"), pick(2, "double").alias("confidenza"), pick(3, "boolean").alias("incerto"), pick(4, "boolean").alias("illeggibile"))
