"""Text rules as column expressions: Spanish normalisation, names, dates, votes and routing.

Fixed word lists that results depend on stand together below, in their natural order.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values ---------------------------------------------------------------

#: Substring of a normalised label -> party, first match first.
PARTY_RULES = [
    ("presidencia", "Presidencia"), ("gobierno", "Gobierno"), ("mixto", "Grupo Mixto"), ("confederal", "Unidas Podemos"), ("unidas podemos", "Unidas Podemos"),
    ("izquierda unida", "Unidas Podemos"), ("en comu", "Unidas Podemos"), ("podemos", "Unidas Podemos"), ("sumar", "Sumar"), ("socialista", "PSOE"), ("popular", "PP"), ("vox", "VOX"),
    ("ciudadanos", "Cs"), ("esquerra", "ERC"), ("republicano", "ERC"), ("nacionalista vasco", "PNV"), ("eaj", "PNV"), ("pnv", "PNV"), ("bildu", "EH Bildu"),
    ("euskal herria", "EH Bildu"), ("junts", "Junts"), ("plural", "Grupo Plural"), ("canari", "Coalición Canaria"),
]
#: A whole word -> party, where no substring matched.
PARTY_WORDS = [
    ("psoe", "PSOE"), ("pp", "PP"), ("vox", "VOX"), ("cs", "Cs"), ("erc", "ERC"), ("pnv", "PNV"), ("bildu", "EH Bildu"), ("junts", "Junts"), ("sumar", "Sumar"),
    ("podemos", "Unidas Podemos"), ("mixto", "Grupo Mixto"), ("cup", "CUP"), ("bng", "BNG"), ("cc", "Coalición Canaria"), ("upn", "UPN"), ("pdecat", "Junts"),
]
MONTHS = ["enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre"]
#: Asking to take sides, on normalised text.
PARTISAN = [
    r"(mas|menos) (corrupto|corrupta|honesto|honrado|honrada|mentiroso|mentirosa|ladron|ladrona|incompetente|fiable|creible|culpable|peligroso|peligrosa)",
    r"(mejor|peor) (partido|grupo|lider|politic[oa]|president[ea])",
    r"que (partido|grupo|politic[oa]) es (el |la )?(mas|mejor|peor)",
    r"(a|por) quien (deberia |hay que |habria que )?(votar|votaria)",
    r"que (partido|grupo) (deberia |habria que )?votar",
    r"quien (miente|tiene razon|es mejor|es peor|es el mejor|es el peor|es mas)",
    r"\b(que opinas|que piensas|en tu opinion|tu opinion|que te parece|crees que es)\b",
]
# (escaño never meets a text without marks; it stays as the fixed value it is)
POLITICAL = (
    "polit gobierno congreso senado pleno diput minist president partido grupo ley leyes decreto presupuest enmienda mocion investidura parlament vot escaño "
    "oposicion coalicion constitucion reforma referendum amnistia legislatura sesion sanidad vivienda educacion inmigracion migra refugiad aborto pension impuesto "
    "fiscal autonomi estado nacion estatuto comparecencia interpelacion proposicion debate empleo paro salario energia clima ambiente igualdad genero violencia "
    "terrorismo seguridad independencia catalun euskadi otan ucrania europe okupa corrupcion economia deficit deuda subvencion"
).split()
NUMBER = r"\b(?:pleno|sesion)\s+(?:n[o]?\s*)?(\d{1,4})\b"
TERM = r"\blegislatura\s+(\d{1,2})\b"
NEWEST = r"\b(ultim[oa]|mas reciente|reciente|mas nuev[oa])\b"
OLDEST = r"\b(primer[oa]?|mas antigu[oa]|mas viej[oa]|inicial)\b"
#: Results of a vote, number after the label; and number before it, where a total may follow remote votes.
VOTES_AFTER = r"(?i)(?:votos\s+emitidos[,:]?\s*(\d+)[;,.\s]+)?(?:votos\s+)?a\s+favor[,:]?\s*(\d+)[;,.\s]+(?:votos\s+)?en\s+contra[,:]?\s*(\d+)(?:[;,.\s]+abstenci\p{L}*[,:]?\s*(\d+))?"
VOTES_BEFORE = r"(?i)(\d+)\s+votos?\s+a\s+favor(?:\s+más\s+\d+\s+votos?\s+telem\p{L}*,?\s*(\d+))?[;,\s]+(\d+)\s+(?:votos?\s+)?en\s+contra(?:\s+más\s+\d+\s+votos?\s+telem\p{L}*,?\s*(\d+))?(?:[;,\sy]+(\d+)\s+abstenci\p{L}*)?"
#: Letters of the Latin blocks that Unicode composes of one letter and marks, and that letter: a rule, no list.
_COMPOSED = {chr(i): d[0] for i in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)) if len(d := unicodedata.normalize("NFD", chr(i))) > 1 and all(unicodedata.category(m) == "Mn" for m in d[1:])}
MARKED, BARE = "".join(_COMPOSED), "".join(_COMPOSED.values())
#: Characters of Western text that Unicode's compatibility forms spell otherwise (ordinals, fractions, ligatures, full width), and how, without marks: a rule, no list.
_COMPATIBLE = {
    c: t
    for c in map(chr, (*range(0xA0, 0x250), *range(0x1E00, 0x1F00), *range(0x2000, 0x2190), *range(0xFB00, 0xFB07), *range(0xFF01, 0xFF5F)))
    if (t := "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))) != c
}
_ONE = {c: t for c, t in _COMPATIBLE.items() if len(t) == 1}
_MORE = {c: t for c, t in _COMPATIBLE.items() if len(t) > 1}
#: The town hall's name in a body's own, and the article after it.
BODY = r"^\s*(ayuntamiento|ajuntament|concello|udala?)\s+(de\s+la\s+|de\s+|del\s+|d')?"

# Expressions ----------------------------------------------------------------


def bare(c: Column) -> Column:
    """Without marks: any composed Latin letter as the letter under it, and combining marks dropped. Letters that are not composed, as ł or ø, stay."""
    return F.translate(F.regexp_replace(c, r"\p{Mn}", ""), MARKED, BARE)


def compatible(c: Column) -> Column:
    """Compatibility forms as the letters, digits and signs they stand for, and no marks: º as o, ½ as 1⁄2, ﬁ as fi."""
    one = F.translate(F.regexp_replace(c, r"\p{Mn}", ""), "".join(_ONE), "".join(_ONE.values()))
    spelled = F.create_map(*[F.lit(x) for pair in _MORE.items() for x in pair])
    each = F.array_join(F.transform(F.split(one, ""), lambda x: F.coalesce(F.try_element_at(spelled, x), x)), "")
    return F.when(F.rlike(one, F.lit("[" + "".join(_MORE) + "]")), each).otherwise(one)


def ascii_only(c: Column) -> Column:
    """compatible() without what is still not ASCII."""
    return F.regexp_replace(compatible(c), r"[^\x00-\x7f]", "")


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def norm_key(c: Column) -> Column:
    """The key that names are compared by: no marks, lower case, digits, letters and hyphens."""
    return squeeze(F.regexp_replace(F.lower(bare(F.coalesce(c, F.lit("")))), r"[^0-9a-z\s-]", " "))


def first_rule(key: Column, rules: list[tuple[str, str]], otherwise: Column) -> Column:
    out = None
    for needle, name in rules:
        hit = F.contains(key, F.lit(needle))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(otherwise)


def canonical_party(c: Column) -> Column:
    key, raw = norm_key(c), F.trim(F.coalesce(c, F.lit("")))
    cleaned = F.trim(F.regexp_replace(raw, r"(?i)^grupo parlamentario\s+", ""))
    return F.when(key == "", "").otherwise(first_rule(key, PARTY_RULES, F.when(cleaned != "", cleaned).otherwise(raw)))


def detect_party(c: Column) -> Column:
    """The first party that a text mentions by rule, or by a whole word; else null."""
    key = norm_key(c)
    words = F.split(key, " ")
    by_word = None
    for w, name in PARTY_WORDS:
        hit = F.array_contains(words, w)
        by_word = F.when(hit, name) if by_word is None else by_word.when(hit, name)
    return first_rule(key, PARTY_RULES, by_word)


def speaker_name(c: Column) -> Column:
    """A speaker without the office in parentheses at its end."""
    return squeeze(F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), r"\s*\([^)]*\)\s*$", ""))


def phonetic_key(c: Column) -> Column:
    """How a Spanish text sounds, roughly: b and v alike, h mute, c and z as s or k, ll as y, doubles single. A c or g that ends the text counts as before e."""
    s = bare(F.lower(c))
    for a, b in (("ll", "y"), ("qu", "k"), ("gu", "g")):
        s = F.replace(s, F.lit(a), F.lit(b))
    s = F.regexp_replace(s, "c(?=[ei]|\\z)", "s")
    s = F.regexp_replace(s, "g(?=[ei]|\\z)", "j")
    s = F.regexp_replace(s, r"[^\p{L}]|h", "")
    return F.regexp_replace(F.translate(s, "vzcy", "bski"), r"(.)\1+", "$1")


def slug(c: Column) -> Column:
    """A body's short name for addresses: without the kind of body before it."""
    s = F.regexp_replace(F.lower(ascii_only(F.coalesce(c, F.lit("")))), BODY, "")
    s = F.regexp_replace(F.regexp_replace(s, "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(s == "", "entidad").otherwise(s)


def iso_date(c: Column) -> Column:
    """'1 de marzo de 2016' as 2016-03-01; null where there is none."""
    p = r"(?i)(\d{1,2})\s+de\s+([a-záéíóú]+)\s+de\s+(\d{4})"
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(bare(F.regexp_extract(c, p, 2))))
    day, year = F.regexp_extract(c, p, 1), F.regexp_extract(c, p, 3)
    return F.when(month > 0, F.concat_ws("-", year, F.lpad(month.cast("string"), 2, "0"), F.lpad(day, 2, "0")))


def long_date(c: Column) -> Column:
    """2016-03-01 or 1/3/2016 as '1 de marzo de 2016'; anything else stays."""
    iso, dmy = r"^\s*(\d{4})-(\d{1,2})-(\d{1,2})\s*$", r"^\s*(\d{1,2})[/-](\d{1,2})[/-](\d{4})\s*$"
    pick = lambda i, j: F.when(F.rlike(c, F.lit(iso)), F.regexp_extract(c, iso, i)).when(F.rlike(c, F.lit(dmy)), F.regexp_extract(c, dmy, j)).try_cast("int")
    d, m, y = pick(3, 1), pick(2, 2), pick(1, 3)
    name = F.try_element_at(F.array(*[F.lit(x) for x in MONTHS]), F.when(m.between(1, 12), m))
    return F.coalesce(F.when(name.isNotNull(), F.concat(d.cast("string"), F.lit(" de "), name, F.lit(" de "), y.cast("string"))), c, F.lit(""))


def clock(seconds: Column, pad: bool = True) -> Column:
    s = F.floor(seconds)
    return F.format_string("%02d:%02d:%02d" if pad else "%d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)


def minutes(seconds: Column) -> Column:
    """M:SS, with as many minutes as there are."""
    s = F.floor(seconds)
    return F.format_string("%d:%02d", F.floor(s / 60), s % 60)


def word_count(c: Column) -> Column:
    t = squeeze(F.coalesce(c, F.lit("")))
    return F.when(t == "", 0).otherwise(F.size(F.split(t, " ")))


def sentences(c: Column) -> Column:
    """Cut after . ! or ? where white space and a capital, an opening mark or a parenthesis follow; white space is one space first. No sentence in an empty text."""
    t = squeeze(F.regexp_replace(c, r"^\s+|\s+$", ""))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, r"(?<=[.!?])\s+(?=[A-ZÁÉÍÓÚÑ¿¡(])"))


def statements(c: Column, least: int = 25) -> Column:
    """Cut after . ! or ? and at line ends; parts of least characters or more."""
    parts = F.transform(F.split(c, r"(?<=[.!?])\s+|\n+"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", ""))
    return F.filter(parts, lambda p: F.length(p) >= least)


def clauses(c: Column) -> Column:
    """Cut after . : ; ! or ? and white space."""
    return F.split(c, r"(?<=[.:;!?])\s+")


def any_of(c: Column, patterns: list[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | F.rlike(c, F.lit(p))
    return out


def verdict(question: Column) -> Column:
    """'opinion' asks to take sides, 'ok' is political, the rest is off the topic."""
    key = norm_key(question)
    hint = F.lit(False)
    for h in POLITICAL:
        hint = hint | F.contains(key, F.lit(h))
    return F.when(any_of(key, PARTISAN), "opinion").when(detect_party(question).isNotNull() | hint, "ok").otherwise("off_topic")


def temporal(question: Column) -> Column:
    """struct(orden, num, leg): which session a question names, by order, number or term."""
    key = norm_key(question)
    num = lambda p: F.nullif(F.regexp_extract(key, p, 1), F.lit("")).cast("int")
    order = F.when(F.rlike(key, F.lit(NEWEST)), "reciente").when(F.rlike(key, F.lit(OLDEST)), "antiguo")
    return F.struct(order.alias("orden"), num(NUMBER).alias("num"), num(TERM).alias("leg"))


def votes(c: Column) -> Column:
    """array<struct(pos, emitidos, a_favor, en_contra, abstenciones)> of all results in a text, in their order.

    A text is cut at the matches of each format, and only if it speaks of a favor: what lies before a match is its place, and the numbers are read from the match,
    so a result that is said twice has two places.
    """
    number = lambda x, p, i: F.nullif(F.regexp_extract(x, p, i), F.lit("")).cast("int")

    def placed(pattern):
        """array<struct(at, m)>: the matches and their places."""
        found, gaps = F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), F.split(c, pattern)
        size = lambda a, n: F.aggregate(F.slice(a, F.lit(1), n), F.lit(0), lambda s, x: s + F.length(x))
        return F.transform(found, lambda m, i: F.struct((size(gaps, i + 1) + size(found, i) + 1).alias("at"), m.alias("m")))

    def row(x, total, yes, no, none):
        return F.struct(x["at"].alias("pos"), total.alias("emitidos"), yes.alias("a_favor"), no.alias("en_contra"), none.alias("abstenciones"))

    def after(x):
        return row(x, *[number(x["m"], VOTES_AFTER, i) for i in (1, 2, 3, 4)])

    def before(x):
        n = [number(x["m"], VOTES_BEFORE, i) for i in range(1, 6)]
        return row(x, F.lit(None).cast("int"), F.coalesce(n[1], n[0]), F.coalesce(n[3], n[2]), n[4])

    both = F.concat(F.transform(placed(VOTES_AFTER), after), F.transform(placed(VOTES_BEFORE), before))
    return F.when(F.rlike(c, F.lit("(?i)favor")), F.array_sort(both)).when(c.isNotNull(), F.array().cast("array<struct<pos:int,emitidos:int,a_favor:int,en_contra:int,abstenciones:int>>"))


def escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def within_one_edit(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b, 1) >= 0
