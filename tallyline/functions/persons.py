"""Given names, the parts of a person's name, and what tells a business from a person."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyline.functions.bind import let
from tallyline.functions.text import norm_name, norm_text, strip_diacritics

# The variants of given names, a group a line, the canonical one first.
GIVEN_NAMES = (
    ("JOSE", "JOSEP", "PEP"),
    ("JUAN", "JOAN"),
    ("JORGE", "JORDI"),
    ("FRANCISCO", "FRANCESC", "CESC", "PACO"),
    ("JAVIER", "XAVIER", "XAVI"),
    ("MIGUEL", "MIQUEL"),
    ("PEDRO", "PERE"),
    ("LUIS", "LLUIS"),
    ("ENRIQUE", "ENRIC"),
    ("ANTONIO", "ANTONI", "TONI"),
    ("MARIA",),
    ("ANGEL",),
    ("RAMON",),
    ("MONTSERRAT", "MONTSE"),
    ("NURIA",),
    ("CARLOS", "CARLES"),
    ("MARCOS", "MARC"),
    ("ANA", "ANNA"),
    ("JAIME", "JAUME"),
    ("JOAQUIN", "JOAQUIM", "QUIM"),
    ("FERNANDO", "FERRAN"),
    ("VICENTE", "VICENC"),
    ("ANDRES", "ANDREU"),
    ("ESTEBAN", "ESTEVE"),
    ("GUILLERMO", "GUILLEM"),
    ("MANUEL", "MANEL"),
    ("AGUSTIN", "AGUSTI"),
    ("DOMINGO", "DOMENEC"),
    ("ALBERTO", "ALBERT"),
    ("SERGIO", "SERGI"),
    ("EDUARDO", "EDUARD"),
    ("RICARDO", "RICARD"),
    ("RAFAEL", "RAFEL"),
    ("IGNACIO", "IGNASI", "NACHO"),
    ("ALEJANDRO", "ALEX"),
    ("PABLO", "PAU"),
    ("GERARDO", "GERARD"),
    ("ROSA",),
    ("ISABEL", "ELISABET"),
    ("ELENA", "HELENA"),
    ("CRISTINA",),
    ("SILVIA",),
    ("EVA",),
    ("PILAR",),
    ("DOLORES", "DOLORS", "LOLA"),
    ("MERCEDES", "MERCE"),
    ("TERESA",),
    ("ROSARIO", "ROSER"),
    ("NIEVES", "NEUS"),
    ("INMACULADA", "IMMACULADA", "IMMA"),
    ("ANGELES", "ANGELS"),
    ("CARMEN", "CARME"),
    ("CARLA",),
    ("CLARA",),
    ("JULIA",),
    ("PAULA",),
    ("SARA",),
    ("MARTA",),
    ("LAURA",),
    ("MIREIA",),
    ("GEMMA",),
    ("MERITXELL",),
    ("LAIA",),
    ("AINA",),
    ("ALBA",),
    ("JUDIT", "JUDITH"),
    ("RAQUEL",),
    ("SONIA",),
    ("SUSANA",),
    ("MONICA",),
    ("VERONICA",),
    ("LOURDES",),
    ("ESTHER", "ESTER"),
    ("BEATRIZ", "BEATRIU"),
    ("PATRICIA",),
    ("LIDIA",),
    ("OLGA",),
    ("IRENE",),
    ("DAVID",),
    ("DANIEL", "DANI"),
    ("ORIOL",),
    ("ROGER",),
    ("ARNAU",),
    ("MARTI",),
    ("POL",),
    ("BIEL",),
    ("NIL",),
    ("VICTOR",),
    ("HUGO",),
    ("MARIO",),
    ("RUBEN",),
    ("ADRIAN", "ADRIA"),
    ("OSCAR",),
    ("RAUL",),
    ("SALVADOR",),
    ("SANTIAGO", "SANTI"),
    ("TOMAS",),
    ("GABRIEL",),
    ("MATEO", "MATEU"),
    ("LORENZO", "LLORENC"),
    ("BERNARDO", "BERNAT"),
    ("ROSA MARIA",),
)

# What only a business's name has, as patterns on text in lower case without accents.
BUSINESS_PATTERNS = (
    r"s\.?\s?l\.?\s?u?\.?",
    r"s\.?\s?a\.?\s?u?\.?",
    r"s\.?\s?c\.?\s?p\.?",
    r"s\.?\s?c\.?\s?c\.?\s?l\.?",
    r"s\.?\s?l\.?\s?n\.?\s?e\.?",
    r"c\.?\s?b\.?",
    r"sociedad",
    r"societat",
    r"cooperativ\w*",
    r"coop",
    r"asociaci\w*",
    r"associaci\w*",
    r"fundaci\w*",
    r"comunidad",
    r"comunitat",
    r"ajuntament",
    r"ayuntamiento",
    r"generalitat",
    r"diputaci\w*",
    r"consorci\w*",
    r"agencia",
    r"tesorer\w*",
    r"hisenda",
    r"hacienda",
    r"banc",
    r"banco",
    r"bank",
    r"caixa",
    r"caja",
    r"seguros",
    r"assegurances",
    r"insurance",
    r"ltd",
    r"limited",
    r"gmbh",
    r"b\.?v\.?",
    r"s\.?a\.?r\.?l\.?",
    r"a\.?g\.?",
    r"inc",
    r"plc",
    r"holding",
    r"group",
    r"grup",
    r"serveis",
    r"servicios",
    r"reformes",
    r"reformas",
    r"construccion\w*",
    r"constructor\w*",
    r"ascensor\w*",
    r"elevator\w*",
    r"instal·?lacion\w*",
    r"instalacion\w*",
    r"manteniment\w*",
    r"mantenimiento\w*",
    r"administraci\w*",
    r"gestor\w*",
    r"assessor\w*",
    r"asesor\w*",
    r"arquitect\w*",
    r"enginyer\w*",
    r"ingenier\w*",
    r"electric\w*",
    r"fontaner\w*",
    r"pintur\w*",
    r"obras",
    r"obres",
    r"energ\w*",
    r"telecom\w*",
    r"movil",
    r"endesa",
    r"naturgy",
    r"iberdrola",
    r"aigues",
    r"aguas",
)
BUSINESS_KINDS = ("vendor", "administrator", "bank", "public_body", "insurer", "architect")


def _canonical() -> Column:
    pairs = [(name, group[0]) for group in GIVEN_NAMES for name in group]
    return F.create_map(*(F.lit(x) for p in pairs for x in p))


def known_given(token: Column) -> Column:
    return token.isin(*(name for group in GIVEN_NAMES for name in group))


def canonical_given(name: Column) -> Column:
    """A given name's canonical variant; an unknown one in its normalised form."""
    return let(norm_name(name), lambda n: F.coalesce(F.try_element_at(_canonical(), n), n))


def _parts(given: Column, surnames: Column, order: str) -> Column:
    return F.struct(
        F.array_join(given, " ").alias("given"), F.coalesce(F.get(surnames, F.lit(0)), F.lit("")).alias("surname1"), F.array_join(F.slice(surnames, F.lit(2), F.greatest(F.size(surnames), F.lit(1))), " ").alias("surname2"),
        F.lit(order).alias("order"),
    )


def _words(c: Column) -> Column:
    return F.filter(F.split(norm_name(c), " "), lambda w: w != "")


def split_name(c: Column) -> Column:
    """struct(given, surname1, surname2, order) of a person's name.

    What stands before a comma are surnames. Otherwise surnames come first if the last word is a known given name and the first isn't.
    One or two known words make the given name; if none is known, one word does, two of four or more where it stands first.
    """
    raw = F.coalesce(c, F.lit(""))

    def plain(t):
        n = F.size(t)
        most = F.least(F.lit(2), n - 1)
        first, second, last, before = (F.coalesce(known_given(F.coalesce(F.get(t, at), F.lit(""))), F.lit(False)) for at in (F.lit(0), F.lit(1), n - 1, n - 2))
        ahead = F.when(first & second & (most >= 2), 2).when(first & (most >= 1), 1).otherwise(F.when(n >= 4, 2).otherwise(1))
        behind = F.when(last & before & (most >= 2), 2).otherwise(1)
        surnames_first = _parts(F.slice(t, n - behind + 1, behind), F.slice(t, F.lit(1), n - behind), "surnames_first")
        given_first = _parts(F.slice(t, F.lit(1), ahead), F.slice(t, ahead + 1, F.greatest(n - ahead, F.lit(0))), "given_first")
        return F.when(n <= 1, _parts(t, F.slice(t, 1, 0), "given_first")).when(last & ~first, surnames_first).otherwise(given_first)

    comma = _parts(_words(F.regexp_replace(raw, "^[^,]*,", "")), _words(F.substring_index(raw, ",", 1)), "surnames_first")
    return F.when(F.contains(raw, F.lit(",")), comma).otherwise(let(_words(raw), plain))


def looks_like_business(name: Column) -> Column:
    return F.coalesce(F.lower(strip_diacritics(name)).rlike(rf"(^|[^a-z0-9])({'|'.join(BUSINESS_PATTERNS)})([^a-z0-9]|$)"), F.lit(False))


def is_person(name: Column, kind: Column, flags: Column, known_business: Column | None = None) -> Column:
    """True for a counterparty that is taken for a natural person: flagged as one, or named and nothing says business. known_business: its name is a party's."""
    flagged = F.coalesce(F.array_contains(flags, "person_beneficiary"), F.lit(False))
    business = F.coalesce(kind.isin(*BUSINESS_KINDS), F.lit(False)) | looks_like_business(name)
    if known_business is not None:
        business = business | F.coalesce(known_business, F.lit(False))
    return norm_text(name).isNotNull() & (flagged | ~business)
