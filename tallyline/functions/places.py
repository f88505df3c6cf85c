"""Floors and doors of units, and paths of extracted fields."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyline.functions.bind import let
from tallyline.functions.text import strip_diacritics

#: Words for floors by what they are written as, ordinals included.
FLOORS = {
    "BJ": "BJ BJO BAJO BAJOS BAIX BAIXOS PB PLANTABAJA PLANTABAIXA LOCAL LOC TIENDA BOTIGA", "EN": "EN ENT ENTL ENTLO ENTRESUELO ENTRESOL ENTRESSOL", "PR": "PR PRAL PRL PRINCIPAL", "AT": "AT ATC ATICO ATIC", "SA": "SA SAT SOBREATICO SOBREATIC", "ST": "ST SOT SOTANO SOTERRANI SS",
    "SM": "SM SEMISOTANO SEMISOTERRANI", "1": "PRIMER PRIMERA PRIMERO", "2": "SEGON SEGONA SEGUNDO SEGUNDA", "3": "TERCER TERCERA TERCERO", "4": "QUART QUARTA CUARTO CUARTA", "5": "CINQUE CINQUENA QUINTO QUINTA",
    "6": "SISE SISENA SEXTO SEXTA", "7": "SETE SETENA SEPTIMO SEPTIMA", "8": "VUITE VUITENA OCTAVO OCTAVA",
}
#: Words for doors.
DOORS = {"IZ": "IZ IZQ IZQUIERDA ESQ ESQUERRA E", "DR": "DR DER DCHA DERECHA DRETA D", "C": "C CTR CENTRO CENTRE", "1": "UNICA UNICO UNIC"}
#: Words that name a part of a label, and those that a staircase follows.
PARTS = "PIS PISO PLANTA PL PT PTA PORTA PUERTA BLOQUE BLOC BQ ENTITAT ENTIDAD FINCA".split()
STAIRS = "ESC ESCALA ESCALERA ES".split()


def _words(groups: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for to, words in groups.items() for w in words.split() for x in (w, to)))


def _clean(c: Column) -> Column:
    return F.nullif(F.regexp_replace(F.upper(strip_diacritics(F.regexp_replace(c, "[ºª°.]", ""))), r"\s+", ""), F.lit(""))


def floor(c: Column) -> Column:
    """A floor in one spelling: BJ for the ground floor, ST below it, numbers without zeros and ordinal endings."""

    def read(s):
        number = F.regexp_extract(s, r"^(-?\d+)[A-Z]{0,3}$", 1).try_cast("int")
        return F.coalesce(F.try_element_at(_words(FLOORS), s), F.when(number == 0, "BJ").when(number < 0, "ST").otherwise(number.cast("string")), s)

    return let(_clean(c), lambda s: F.when(s.isNotNull(), read(s)))


def door(c: Column) -> Column:
    def read(s):
        return F.coalesce(F.try_element_at(_words(DOORS), s), F.regexp_extract(s, r"^(\d+)[A-Z]{0,3}$", 1).try_cast("int").cast("string"), s)

    return let(_clean(c), lambda s: F.when(s.isNotNull(), read(s)))


def split_label(c: Column) -> Column:
    """struct(floor, door) of a unit's label, as written: brackets, names of parts and the staircase are left out."""
    text = F.regexp_replace(F.regexp_replace(F.upper(strip_diacritics(F.regexp_replace(c, "[ºª°.]", ""))), r"\([^)]*\)", " "), rf"(^|[\s,\-/])({'|'.join(STAIRS)})[\s,\-/]+[^\s,\-/]+", " ")
    kept = F.filter(F.split(text, r"[\s,\-/]+"), lambda t: (t != "") & ~t.isin(*PARTS, *STAIRS))
    return let(kept, lambda k: F.struct(F.get(k, F.lit(0)).alias("floor"), F.get(k, F.lit(1)).alias("door")))


def field_path(c: Column) -> Column:
    """A path with its places in brackets: a.0.b as a[0].b."""
    return F.regexp_replace(F.regexp_replace(F.trim(c), r"\.(\d+)(?=\.|\[|$)", "[$1]"), r"\[\s*(\d+)\s*\]", "[$1]")


def path_matches(pattern: str, path: Column) -> Column:
    """True if path is pattern, in which [*] stands for any place."""
    return path.rlike("^" + r"\[\d+\]".join(re.escape(part) for part in pattern.split("[*]")) + "$")


#: Keys of whole numbers and dates, and parts of keys of amounts.
INT_KEYS = "orden page_index paradas ejercicio validez_dias numero_plazos favor contra abstencion quorum_unidades pagina de plazo_meses".split()
DATE_KEYS = "vencimiento desde hasta fin_previsto fecha_cierre_acta aprobada_en_junta fecha_convocatoria".split()
AMOUNT_KEYS = (
    "importe total base cuota saldo precio pct pem suplidos cantidad principal carga_kg limite coeficiente quorum dotacion disposiciones inicial final recaudado aplicado pendiente anterior actual a_origen resultado en_banco "
    "en_caja deuda"
).split()


def field_kind(path: Column, json_type: Column) -> Column:
    """bool, nif, iban, date, int, amount or text: by the last key of a path and the value's type in JSON (boolean, number, string or null)."""

    def of(key):
        return (
            F.when(json_type == "boolean", "bool").when(key == "nif", "nif").when(F.contains(key, F.lit("iban")), "iban").when(key.isin(*DATE_KEYS) | key.rlike("^(fecha|data)(_|$)"), "date")
            .when(key.isin(*INT_KEYS) | key.rlike("_meses$"), "int").when(json_type == "number", "amount").when(json_type == "string", "text").when(key.rlike("|".join(AMOUNT_KEYS)), "amount").otherwise("text")
        )

    return let(F.regexp_replace(F.substring_index(path, ".", -1), r"\[\d+\]$", ""), of)
