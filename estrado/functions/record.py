"""Rules of the record as column expressions: groups, offices and roles, topics, points of the agenda, captions and measures.

Fixed word lists that results depend on stand together below, in their natural order.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ascii_only, bare, compatible, squeeze, votes

# Fixed values ---------------------------------------------------------------

#: Stem in a group's name -> its letters, first match first; stems, as names are cut off at line ends.
GROUP_STEMS = [
    ("social", "PSOE"), ("popul", "PP"), ("vox", "VOX"), ("ciuda", "Cs"), ("euska", "EH Bildu"), ("bildu", "EH Bildu"), ("esqu", "ERC"), ("republic", "ERC"),
    ("llibertat", "DL"), ("junts", "Junts"), ("confed", "Podemos"), ("podem", "Podemos"), ("unid", "Podemos"), ("plurinac", "Sumar"), ("sumar", "Sumar"),
    ("nacionalista vasco", "PNV"), ("vasc", "PNV"), ("eaj", "PNV"), ("canari", "CC"), ("plural", "Plural"), ("mixto", "Mixto"),
]
KNOWN_GROUPS = ["PP", "PSOE", "VOX", "Cs", "Podemos", "Sumar", "ERC", "Junts", "EH Bildu", "PNV", "CC", "Plural", "Mixto", "DL"]
GOVERNMENT = ["ministr", "ministerio", "del gobierno", "candidat", "presidente del gobierno", "vicepresidente del", "vicepresidenta del"]
#: Words of an office -> role, first match first.
OFFICES = [
    (["candidat"], "candidato"), (["presidente del gobierno", "presidenta del gobierno"], "presidente del gobierno"), (["vicepresident"], "vicepresidente del gobierno"),
    (["ministr", "ministerio"], "ministro"), (["secretari"], "secretario de estado"),
]
CHAIR = ["PRESIDENT", "VICEPRESIDENT", "SECRETARI"]
FIRST_NAMES = ("don ", "doña ", "doňa ")
GROUP_NAMED = r"grupo (parlamentario [a-záéíóúñ ]+|mixto)"
#: What makes a chair's "sobre ..." the topic, and the topic's words.
ABOUT_WORDS = ["interpelaci", "proposici", "moci", "comparecen", "debate", "toma en consider"]
ABOUT = r"(?iu)\bsobre\b\s+(.{10,150}?)(?:\.|\(n[úu]m|, que formula|\bque formula\b|$)"
#: All of the words, any of the alternatives within one -> topic, first match first.
TOPICS = [
    ([["pregunta"], ["formula"]], "Preguntas al Gobierno"), ([["interpelaci"]], "Interpelaciones urgentes"), ([["moci"]], "Mociones"), ([["proposici"], ["ley"]], "Proposiciones de ley"),
    ([["comparecen"]], "Comparecencias del Gobierno"), ([["convalidaci", "decreto-ley"]], "Convalidación de reales decretos-leyes"), ([["investidura"]], "Debate de investidura"),
    ([["presupuest"]], "Presupuestos Generales del Estado"),
]
#: A sentence of the chair that names a kind of point, and the next sentence that brings in its speaker.
STRONG_CUES = ["orden del dia", "convalidacion", "real decreto", "mocion", "interpelacion", "proposicion", "toma en consideracion", "comparecencia del gobierno", "debate de totalidad"]
INTRODUCTIONS = ["presentacion de la iniciativa", "defensa de la iniciativa", "para presentar", "para defender"]
POINT = (
    r"(?iu)\bpunto\s+(?:n[uú]mero\s+|n[º°]\.?\s*)?(\d{1,2}|uno|dos|tres|cuatro|cinco|seis|siete|ocho|nueve|diez|once|doce|"
    r"primero|segundo|tercero|cuarto|quinto|sexto|s[eé]ptimo|octavo|noveno|d[eé]cimo)\b"
)
STOP_WORDS = "de la que el en y a los del se las por un para con no una su al es lo como mas o pero sus le ya este esta esto muy ha han hay".split()
#: Words that say nothing of a topic, those of the chamber included.
TOPIC_STOP_WORDS = (
    "a al algo algunas algunos ante antes asi como con contra cual cuando de del desde donde durante e el ella ellas ellos en entre era eran es esa esas ese eso esos esta estas este "
    "esto estos fue fueron ha haber habia han hasta hay la las le les lo los mas me mi mis mucho muy nada ni no nos nuestra nuestro o os otra otro para pero poco por porque pues que "
    "quien se senor senora senoria senorias sea ser si sin sobre solo son su sus tambien tan tanto te tiene todo todos tu tus un una uno unos usted ustedes y ya gracias presidente "
    "presidenta diputado diputada grupo parlamentario palabra usia"
).split()
PARTY_HINTS = ["psoe", "socialista", "popular", "vox", "sumar", "junts", "bildu", "republican", "pnv", "eaj", "podemos", "compromis", "canaria", "bng", "mixto"]
CONNECTORS = ["de", "del", "la", "las", "los", "el", "i", "y", "e", "da", "do", "san"]
#: A segment that speaks of voting, and what it then says of the outcome, first match first; without marks.
VOTING = ["voto", "votaci", "a favor", "en contra", "abstenc", "unanim", "asentim"]
OUTCOMES = [
    ("por unanimidad", "Aprobado por unanimidad."), ("se aprueba por mayoria", "Aprobado por mayoría."), ("queda aprobad", "Aprobado."), ("se aprueba", "Aprobado."),
    ("queda rechazad", "Rechazado."), ("se rechaza", "Rechazado."),
]
HONORIFICS = ["senor", "senora", "ministro", "ministra", "vicepresidente", "vicepresidenta", "secretario", "secretaria", "don", "dona"]

# Expressions ----------------------------------------------------------------


def has_any(c: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(c, F.lit(w))
    return out


def text_of(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def group_letters(c: Column) -> Column:
    """A group's letters by the stems in its name; a name without a stem stays, trimmed."""
    low, out = F.lower(text_of(c)), None
    for stem, letters in GROUP_STEMS:
        hit = F.contains(low, F.lit(stem))
        out = F.when(hit, letters) if out is None else out.when(hit, letters)
    return out.otherwise(F.trim(text_of(c)))


def in_government(c: Column) -> Column:
    return has_any(F.lower(text_of(c)), GOVERNMENT)


def office(c: Column) -> Column:
    """The role that an office's words name; of the government otherwise."""
    low, out = F.lower(text_of(c)), None
    for words, role in OFFICES:
        out = F.when(has_any(low, words), role) if out is None else out.when(has_any(low, words), role)
    return out.otherwise("gobierno")


def is_first_name(c: Column) -> Column:
    """Whether a parenthesis holds a first name, that tells namesakes apart, and no office or group."""
    low, out = F.lower(F.trim(text_of(c))), F.lit(False)
    for p in FIRST_NAMES:
        out = out | F.startswith(low, F.lit(p))
    return out


def registry_name(c: Column) -> Column:
    """A name as registries key it: ASCII capitals without marks, hyphens, apostrophes, dots, and without a lone I."""
    ascii_ = F.upper(ascii_only(text_of(c)))
    words = F.split(squeeze(F.regexp_replace(ascii_, "[-'.]", "")), " ")
    return F.array_join(F.filter(words, lambda t: (t != "I") & (t != "")), " ")


def title_case(c: Column) -> Column:
    """Each run of letters with a capital and small letters after it, whatever stands between the runs."""
    runs = F.regexp_extract_all(text_of(c), F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.left(r, F.lit(1))), F.lower(F.substr(r, F.lit(2), F.length(r))))), "")


def group_near(text: Column, name: Column, room: int = 250) -> Column:
    """The letters of the group that a summary names within room characters from a name on, or from its first word where the whole name is not there; else ""."""
    low, name = F.lower(text_of(text)), F.lower(F.trim(text_of(name)))
    whole, first = F.position(name, low), F.position(F.split_part(name, F.lit(" "), F.lit(1)), low)
    at = F.when(whole > 0, whole).otherwise(first)
    found = F.regexp_extract(F.substr(low, at, F.lit(room)), GROUP_NAMED, 0)
    return F.when((at > 0) & (found != ""), group_letters(found)).otherwise("")


def announced_topic(c: Column) -> Column:
    """The topic that a chair's words set: what 'sobre' names in a debate of a known kind, else the kind; null where there is none."""
    low = F.lower(c)
    about = F.regexp_extract(c, ABOUT, 1)
    out = F.when(F.rlike(c, F.lit(ABOUT)) & has_any(low, ABOUT_WORDS), F.regexp_replace(squeeze(about), r"^[ .,;]+|[ .,;]+$", ""))
    for groups, topic in TOPICS:
        hit = F.lit(True)
        for words in groups:
            hit = hit & has_any(low, words)
        out = out.when(hit, topic)
    return out


def simple(c: Column) -> Column:
    """ASCII small letters, single spaces."""
    return squeeze(F.lower(ascii_only(text_of(c))))


def speaker_label(name: Column, party: Column) -> Column:
    """How minutes call a speaker: the government, the chair, nobody known, or the name with its party."""
    n, p = F.trim(text_of(name)), F.trim(text_of(party))
    label = F.when(n == "(miembro del Gobierno)", "Gobierno").when(n.isin("", "(sin identificar)"), "Orador sin identificar").when(n == "Presidencia", "Presidencia")
    return label.otherwise(F.when(p != "", F.concat(n, F.lit(" ("), p, F.lit(")"))).otherwise(n))


def role_of(name: Column, party: Column) -> Column:
    """The role that follows from a name and a party alone."""
    n = text_of(name)
    return F.when(n == "Presidencia", "presidencia").when((text_of(party) == "Gobierno") | (n == "(miembro del Gobierno)") | F.contains(F.lower(n), F.lit("gobierno")), "gobierno").otherwise("diputado")


def spoken_words(c: Column) -> Column:
    """Words as error rates count them: no marks, small letters, 1.200 as 1200, then all but letters, digits and spaces a space."""
    s = compatible(F.lower(text_of(c)))
    s = F.regexp_replace(s, r"(?<=\d)[.](?=\d{3}\b)", "")
    s = squeeze(F.regexp_replace(s, r"[^0-9a-zñ\s]", " "))
    return F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, " "))


def content_words(c: Column) -> Column:
    words = F.regexp_extract_all(F.lower(text_of(c)), F.lit("[a-záéíóúñ]+"), F.lit(0))
    return F.array_except(F.filter(words, lambda w: F.length(w) > 3), F.array(*[F.lit(w) for w in STOP_WORDS]))


def vote_lines(c: Column) -> Column:
    """array<string>: what a segment says of a vote, as minutes write it. Results in numbers, in their order; without any, the outcome that a formula states in words of voting."""
    part = lambda label, n: F.concat(F.lit(f"{label}, "), n.cast("string"))
    told = F.transform(votes(text_of(c)), lambda v: F.concat(F.lit("Efectuada la votación, dio el siguiente resultado: "), F.concat_ws("; ", F.when(v["emitidos"] > 0, part("votos emitidos", v["emitidos"])), part("a favor", v["a_favor"]), part("en contra", v["en_contra"]), part("abstenciones", v["abstenciones"])), F.lit(".")))
    low, out = compatible(F.lower(text_of(c))), F.lit(None).cast("string")
    for said, outcome in reversed(OUTCOMES):
        out = F.when(F.contains(low, F.lit(said)), outcome).otherwise(out)
    return F.when(F.size(told) > 0, told).otherwise(F.array_compact(F.array(F.when(has_any(low, VOTING), out))))


def entities(c: Column) -> Column:
    """Numbers, and capitalised words in small letters, each once."""
    numbers = F.regexp_extract_all(text_of(c), F.lit(r"\b\d+(?:[.,]\d+)?\b"), F.lit(0))
    names = F.regexp_extract_all(text_of(c), F.lit(r"\b[A-ZÁÉÍÓÚÑ][A-Za-záéíóúñ]{2,}\b"), F.lit(0))
    return F.array_distinct(F.concat(numbers, F.transform(names, F.lower)))


def caption_time(seconds: Column) -> Column:
    """hh:mm:ss,mmm"""
    whole = F.floor(seconds)
    ms = F.round((seconds - whole) * 1000).cast("int")
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(whole / 3600), F.floor(whole % 3600 / 60), whole % 60, ms)


def caption(number: Column, start: Column, end: Column, text: Column) -> Column:
    return F.concat_ws("\n", number.cast("string"), F.concat(caption_time(start), F.lit(" --> "), caption_time(end)), text_of(text), F.lit(""))


def asked_topic(c: Column) -> Column:
    """What stands after the first colon of a question, or the question, without marks of question at its ends; null if nothing is left."""
    at = F.position(F.lit(":"), c)
    rest = F.when(at > 0, F.substr(c, at + 1, F.length(c))).otherwise(c)
    return F.nullif(F.regexp_replace(rest, r"^[ ¿?¡!.\t\n]+|[ ¿?¡!.\t\n]+$", ""), F.lit(""))


def agenda_sentences(c: Column) -> Column:
    """A chair's text at the ends of sentences and clauses."""
    return F.split(text_of(c), r"(?<=[.;:])\s+")


def names_a_point(sentence: Column, following: Column) -> Column:
    """Whether a sentence describes a point of the agenda: it names the kind, or the next one brings in who presents it."""
    low = simple(sentence)
    long_ = (F.length(sentence) >= 25) & ~F.contains(low, F.lit("tiene la palabra"))
    return long_ & (has_any(low, STRONG_CUES) | F.coalesce(has_any(simple(following), INTRODUCTIONS), F.lit(False)))


def point_title(c: Column, room: int = 90) -> Column:
    """The first sentence of 18 characters or more after a point was called, cut at a word's end; the whole, if none is as long."""
    parts = F.filter(F.transform(F.split(c, r"[.?]\s"), lambda p: squeeze_ends(p)), lambda p: F.length(p) >= 18)
    t = F.regexp_replace(F.coalesce(F.try_element_at(parts, F.lit(1)), c), r"^[ ,.;:—-]+|[ ,.;:—-]+$", "")
    t = F.when(t == "", "(punto)").otherwise(t)
    cut = F.left(t, F.lit(room))
    return F.when(F.length(t) > room, F.concat(F.regexp_replace(cut, r" [^ ]*$", ""), F.lit("…"))).otherwise(t)


def squeeze_ends(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def sections(c: Column, least: int = 120, most: int = 1400) -> Column:
    """array<struct(k, text)> of a text's parts after each heading '## ': images and line ends go, parts of more than least characters stay, cut at most."""
    parts = F.split(text_of(c), "\n## ")
    body = F.transform(parts, lambda p, i: F.struct(i.alias("k"), F.left(squeeze(F.regexp_replace(p, r"!\[[^\]]*\]\([^)]*\)", " ")), F.lit(most)).alias("text"), (F.length(squeeze(F.regexp_replace(p, r"!\[[^\]]*\]\([^)]*\)", " "))) > least).alias("ok")))
    return F.filter(body, lambda x: (x["k"] > 0) & x["ok"])


def hand(points: dict[str, Column], sure: dict[str, Column]) -> Column:
    """Height of the higher hand over the shoulders in heads: the wrist where it is seen (0.25), else the elbow (0.50).

    points and sure give y and confidence of head0..head4, shoulder0, shoulder1, elbow0, elbow1, wrist0, wrist1. Null without head, shoulder or
    hand, and where head and shoulder are less than 4 apart.
    """
    seen = lambda k, least: F.when(sure[k] > least, points[k])
    head = F.array_min(F.array_compact(F.array(*[seen(f"head{i}", 0.20) for i in range(5)])))
    sh = [seen(f"shoulder{i}", 0.20) for i in range(2)]
    shoulder = F.coalesce((sh[0] + sh[1]) / 2, *sh)
    hands = F.array_compact(F.array(*[F.coalesce(seen(f"wrist{i}", 0.25), seen(f"elbow{i}", 0.50)) for i in range(2)]))
    room = shoulder - head
    return F.when(room >= 4, F.array_max(F.transform(hands, lambda y: (shoulder - y) / room)))


def picked_person(names: Column) -> Column:
    """The longest of the people found in a text, the first in order of equals; null if there is none."""
    order = F.array_sort(F.transform(F.filter(names, lambda n: F.length(n) > 1), lambda n: F.struct((-F.length(n)).alias("l"), n.alias("n"))))
    return F.try_element_at(order, F.lit(1))["n"]


def picked_party(names: Column) -> Column:
    """The government if an organisation is it, else the first that is a group or hints at a party; else ""."""
    key = lambda n: F.lower(bare(n))
    group = F.filter(names, lambda n: has_any(key(n), ["grupo", "parlament", *PARTY_HINTS]))
    return F.when(F.exists(names, lambda n: F.contains(key(n), F.lit("gobierno"))), "Gobierno").otherwise(F.coalesce(F.try_element_at(group, F.lit(1)), F.lit("")))


def is_real_group(names: Column) -> Column:
    return F.exists(names, lambda n: has_any(F.lower(bare(n)), ["grupo", "parlament", "gobierno", *PARTY_HINTS]))
