"""Reading a gazette's text: speeches, groups named in its summary, its date and agenda."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import squeeze

# How a gazette marks its parts.
SPEAKER = r"(?:El señor|La señora)\s+([A-ZÁÉÍÓÚÑÜ][A-ZÁÉÍÓÚÑÜ'.\- ]+?)\s*(?:\(([^)]+)\))?\s*:"
NAMED_FIRST = r"se[ñn]or(?:a)?\s+([A-ZÁÉÍÓÚÑ][A-Za-zÁÉÍÓÚÑáéíóúñ'.\- ]+?)\s*,?\s*del Grupo Parlamentario ([A-Za-záéíóúñ ]+)"
GROUP_FIRST = r"del Grupo Parlamentario ([A-Za-záéíóúñ ]+?)\s*\(\s*se[ñn]or(?:a)?\s+([A-ZÁÉÍÓÚÑ][A-Za-zÁÉÍÓÚÑáéíóúñ'.\- ]+?)\s*\)"
PAGE_HEADER = r"(?s)DIARIO DE SESIONES.*?P[áa]g\.\s*\d+"
HELD_ON = r"(?i)celebrada el [^,]*?(\d{1,2} de \p{L}+ de \d{4})"
FOOTER = r"(?im)^.*(documento firmado electr|autenticidad de este|\bcsv\b|sede\.\w+\.\w+).*$"
ITEM = r"(?imu)^\s*(?:\d{1,2}\s*[.)ºª-]|primero|segundo|tercero|cuarto|quinto|sexto|s[eé]ptimo|octavo|noveno|d[eé]cimo)[.)\-\s]+"
SIGNED = r"(?isu)\n\s*(?:el alcalde-?president|la alcaldesa|fdo\.?\s*:|firmado\s*:).*$"
_CUT, _NAME, _BODY = "\x01", "\x02", "\x03"


def without_headers(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, PAGE_HEADER, " "), r"[ \t]+", " ")


def speeches(c: Column) -> Column:
    """array<struct(speaker, party, text)>: the text from each speaker's mark to the next; marks without text are left out.

    Every mark is rewritten with control characters around its name and group, and the text is cut at those.
    """
    marked = F.regexp_replace(c, SPEAKER, f"{_CUT}$1{_NAME}$2{_BODY}")
    parts = F.slice(F.split(marked, _CUT), F.lit(2), F.greatest(F.size(F.split(marked, _CUT)) - 1, F.lit(0)))
    head = lambda p: F.split_part(p, F.lit(_BODY), F.lit(1))
    out = F.transform(
        parts,
        lambda p: F.struct(
            squeeze(F.split_part(head(p), F.lit(_NAME), F.lit(1))).alias("speaker"), F.trim(F.split_part(head(p), F.lit(_NAME), F.lit(2))).alias("party"), F.regexp_replace(F.split_part(p, F.lit(_BODY), F.lit(2)), r"^\s+|\s+$", "").alias("text")
        ),
    )
    return F.filter(out, lambda x: x["text"] != "")


#: Fixed values of a city council's gazette: its page header, remarks of the stenographer, where the session begins, the chair's and others' marks, names in them, and groups, first match first.
COUNCIL_HEADER = r"(?s)Diario de Sesiones del Pleno del Ayuntamiento de Madrid.*?N[úu]m\.\s*[\d.]+"
COUNCIL_REMARK = r"\((?:Aplausos|Rumores|Protestas|Risas|El se[ñn]or[^)]*|La se[ñn]ora[^)]*)\.?\)"
COUNCIL_BEGINS = r"(?isu)^.*?(se abre la sesi[óo]n.*)$"
COUNCIL_MARK = (
    r"(El presidente|El secretario general|El secretario|El alcalde|La alcaldesa)\s*:"
    r"|([^.:\n]{0,180}?\b(?:don|do[ñn]a)\s+[A-ZÁÉÍÓÚÑ][A-Za-zÁÉÍÓÚÑáéíóúñ\-]+(?:\s+[A-ZÁÉÍÓÚÑ][A-Za-zÁÉÍÓÚÑáéíóúñ\-]+){0,3})\s*:"
)
COUNCIL_NAME = r"(?iu)(?:don|do[ñn]a)\s+(.+)$"
COUNCIL_GROUPS = [("partido popular", "PP"), ("m[áa]s madrid", "Más Madrid"), ("socialista", "PSOE"), ("vox", "VOX"), ("mixto", "Mixto")]
#: A speech is longer than this.
SHORTEST = 15


def council_speeches(c: Column) -> Column:
    """array<struct(speaker, party, role, text)> of a city council's gazette: the text from each mark to the next, without remarks; page headers go before, so that a mark may stand across two pages.

    What comes before the session is opened is its summary and holds no speech. The chair is called by its office; others by the name after don or doña, with the group that the words before it name.
    """
    plain = F.regexp_replace(F.regexp_replace(c, COUNCIL_HEADER, " "), r"[ \t]+", " ")
    opened = F.regexp_extract(plain, COUNCIL_BEGINS, 1)
    body = F.when(opened != "", opened).otherwise(plain)
    parts = F.split(F.regexp_replace(body, COUNCIL_MARK, f"{_CUT}$1{_NAME}$2{_BODY}"), _CUT)
    marked = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))

    def speech(p):
        head, said = F.split_part(p, F.lit(_BODY), F.lit(1)), F.split_part(p, F.lit(_BODY), F.lit(2))
        chair, other = F.split_part(head, F.lit(_NAME), F.lit(1)), F.split_part(head, F.lit(_NAME), F.lit(2))
        name, group = F.regexp_extract(other, COUNCIL_NAME, 1), F.lit("")
        for pattern, letters in reversed(COUNCIL_GROUPS):
            group = F.when(F.rlike(F.lower(other), F.lit(pattern)), letters).otherwise(group)
        who = F.when(chair != "", chair).when(name != "", F.trim(F.regexp_replace(name, r"\s+", " "))).otherwise(F.regexp_replace(other, r"^\s+|\s+$", ""))
        text = F.regexp_replace(F.regexp_replace(F.regexp_replace(said, COUNCIL_REMARK, ""), r"^[ .—-]+|[ .—-]+\z", ""), r"\s+", " ")
        return F.struct(who.alias("speaker"), F.when(chair != "", "").otherwise(group).alias("party"), F.when(chair != "", "presidencia").otherwise("concejal").alias("role"), text.alias("text"))

    return F.filter(F.transform(marked, speech), lambda x: F.length(x["text"]) > SHORTEST)


def group_mentions(c: Column) -> Column:
    """array<struct(name, grupo)>: whom a summary names with a group, in either order."""
    pair = lambda p, name, group: F.arrays_zip(F.regexp_extract_all(c, F.lit(p), F.lit(name)).alias("name"), F.regexp_extract_all(c, F.lit(p), F.lit(group)).alias("grupo"))
    return F.concat(pair(NAMED_FIRST, 1, 2), pair(GROUP_FIRST, 2, 1))


#: Where the block of the agenda in a gazette's head begins and ends.
ORDER_OF_DAY = r"(?isu)orden del d[ií]a[\s:.]*(.{15,400})"
ORDER_ENDS = ("sumario", "se abre la sesión", "se reanuda", "comienza la sesión")


def session_topic(c: Column) -> Column:
    """The block after 'orden del día' without dotted leaders, up to the first word that ends it, 300 characters at most; "" where there is none."""
    t = squeeze(F.regexp_replace(squeeze(F.regexp_extract(c, ORDER_OF_DAY, 1)), r"\.{3,}\s*\d*", " "))
    for stop in ORDER_ENDS:
        at = F.position(F.lit(stop), F.lower(t)) - 1
        t = F.when(at > 15, F.substr(t, F.lit(1), at)).otherwise(t)
    return F.left(F.regexp_replace(squeeze(t), r"^[ .:;-]+|[ .:;-]+$", ""), F.lit(300))


def held_on(c: Column) -> Column:
    return F.regexp_extract(c, HELD_ON, 1)


def agenda_text(c: Column) -> Column:
    """The points of agenda(), each on its line; where there are fewer than two the whole block of the agenda, 2,000 characters at most."""
    points = agenda(c)
    return F.when(F.size(points) >= 2, F.array_join(points, "\n")).otherwise(F.left(squeeze(F.regexp_replace(_agenda_block(c), r"^\s+|\s+$", "")), F.lit(2000)))


def _agenda_block(c: Column) -> Column:
    body = F.regexp_replace(F.regexp_replace(c, FOOTER, ""), SIGNED, "")
    return F.regexp_replace(body, r"(?isu)^.*?(orden del d[ií]a|ordre del dia)", "")


def agenda(c: Column, most: int = 40) -> Column:
    """The numbered points after the heading, each on one line of at most 200 characters; points under ten are no points."""
    body = _agenda_block(c)
    items = F.split(F.regexp_replace(body, ITEM, _CUT), _CUT)
    rest = F.slice(items, F.lit(2), F.greatest(F.size(items) - 1, F.lit(0)))
    kept = F.filter(rest, lambda p: F.length(F.trim(p)) >= 10)
    return F.slice(F.transform(kept, lambda p: F.trim(F.left(squeeze(p), F.lit(200)))), 1, most)
