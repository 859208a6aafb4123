"""IRI canonical forms, aliases, CURIEs and labels as Column expressions."""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Default prefixes, the CURIE pattern, the N-Triples line, datatype and language patterns.
DEFAULT_PREFIXES = {
    "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#",
    "rdfs": "http://www.w3.org/2000/01/rdf-schema#",
    "xsd": "http://www.w3.org/2001/XMLSchema#",
    "owl": "http://www.w3.org/2002/07/owl#",
    "skos": "http://www.w3.org/2004/02/skos/core#",
    "schema": "http://schema.org/",
    "foaf": "http://xmlns.com/foaf/0.1/",
    "dc": "http://purl.org/dc/elements/1.1/",
    "dcterms": "http://purl.org/dc/terms/",
    "wikidata": "http://www.wikidata.org/prop/direct/",
}
CURIE = r"(?U)^([A-Za-z_][\w\-]*):([^\s:][^\s]*)$"
NT_LINE = r"(?sU)^\s*(<[^>]*>|_:[^\s]+)\s+(<[^>]*>)\s+(.*)\s*\.\s*$"
TYPED = r"(?U)\^\^<([^>]+)>\s*$"
# Possessive, so that long literals don't deepen the matcher's stack.
LANG = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"@([a-zA-Z0-9\-]+)\s*$'
#: Unicode's white space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
XSD_STRING = "<http://www.w3.org/2001/XMLSchema#string>"


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.btrim(c, F.lit(WHITE))


def lookup(table: dict[str, str]) -> Callable[[Column], Column]:
    """What a table of any size has for a text; else null. It is one literal, whose small maps are told apart by checksums."""
    n = max(1, len(table))
    maps: list[dict[str, str]] = [{} for _ in range(n)]
    for key, value in table.items():
        maps[zlib.crc32(key.encode()) % n][key] = value
    literal = F.from_json(F.lit(json.dumps(maps)), "array<map<string,string>>")
    return lambda c: F.try_element_at(F.get(literal, (F.crc32(c) % n).cast("int")), c)


def canonical(c: Column, prefixes: dict[str, str] | None = None) -> Column:
    """<...> of a bracketed IRI, a bare IRI or a CURIE of a known prefix; else null."""
    t = strip(c)
    base = lookup(prefixes or DEFAULT_PREFIXES)(F.regexp_extract(t, CURIE, 1))
    curie = F.concat(F.lit("<"), base, F.regexp_extract(t, CURIE, 2), F.lit(">"))
    return F.when(t.startswith("<") & t.endswith(">"), t).when(t.contains("://"), F.concat(F.lit("<"), t, F.lit(">"))).when(t.rlike(CURIE), curie)


def variants(c: Column) -> Column:
    """The IRI itself and its http or https twin."""
    twin = F.when(c.startswith("<http://"), F.regexp_replace(c, "^<http://", "<https://")).when(c.startswith("<https://"), F.regexp_replace(c, "^<https://", "<http://"))
    return F.array_compact(F.array(c, twin))


def to_curie(c: Column, prefixes: dict[str, str] | None = None) -> Column:
    """prefix:local by the longest base that fits; else null.

    Bases are looked up by their texts: one look for each length that bases
    have, longest first, however many there are.
    """
    inside = F.substring(c, F.lit(2), F.length(c) - 2)
    bases: dict[str, str] = {}
    for prefix, iri in (prefixes or DEFAULT_PREFIXES).items():
        bases.setdefault(iri, prefix)
    find = lookup(bases)
    lengths = F.array(*[F.lit(n) for n in sorted({len(x) for x in bases}, reverse=True)])
    each = F.transform(F.filter(lengths, lambda n: n <= F.length(inside)), lambda n: F.concat(find(F.substring(inside, F.lit(1), n)), F.lit(":"), F.substring(inside, n + 1, F.length(inside))))
    return F.when(c.startswith("<") & c.endswith(">"), F.get(F.array_compact(each), F.lit(0)))


def label(c: Column, prefixes: dict[str, str] | None = None, prefer_curie: bool = True) -> Column:
    """A CURIE if there is one, else what follows the last # or /, else the token."""
    t = strip(c)
    inside = F.substring(t, F.lit(2), F.length(t) - 2)
    local = F.when(inside.contains("#"), F.substring_index(inside, "#", -1)).when(inside.contains("/"), F.substring_index(F.regexp_replace(inside, "/+$", ""), "/", -1)).otherwise(inside)
    bracketed = F.coalesce(to_curie(t, prefixes), local) if prefer_curie else local
    return F.when(t.rlike(CURIE), t).when(t.startswith("<") & t.endswith(">"), bracketed).otherwise(t)


def kind(c: Column, subject: bool = False) -> Column:
    other = F.lit("BNODE" if subject else "LITERAL")
    return F.when(c.startswith("<"), "IRI").when(c.startswith("_:"), "BNODE").otherwise(other)


def with_terms(triples):
    """Adds s_kind, o_kind, datatype and lang (one of the last two for literals)."""
    o = F.col("o")
    literal = kind(o) == "LITERAL"
    typed, lang = F.regexp_extract(o, TYPED, 1), F.lower(F.regexp_extract(o, LANG, 1))
    datatype = F.when(typed != "", F.concat(F.lit("<"), typed, F.lit(">"))).when(lang == "", F.lit(XSD_STRING))
    return triples.withColumns({"s_kind": kind(F.col("s"), True), "o_kind": kind(o), "datatype": F.when(literal, datatype), "lang": F.when(literal & (typed == "") & (lang != ""), lang)})
