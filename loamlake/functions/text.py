"""Text normalisation as Column expressions; what the platform can't express is a pandas UDF at the end."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The stop words as they take effect; two entries have run together in the list that ships.
_STOP = """a as da das de do dos e em foi foram ha no nos o os pela pelo por qual que sao um uma mostra mostram revela
revelam trata sobre estudos abordados aparecem existem jornal mencionam noticias noticia publicou quais relacionadas
pesquisas apontam aponta oncologia cursos usp diz saude educacao""".split()
STOPWORDS: Mapping[str, frozenset[str]] = {
    "shipped": frozenset([*_STOP, "pressao alta", "cursotratam"]),
    "intended": frozenset([*_STOP, "pressao alta", "curso", "tratam"]),
}

# Terms and what they are also called.
SYNONYMS: Mapping[str, Sequence[str]] = {
    "usp": ("universidade", "universidade de sao paulo", "universidade de são paulo"),
    "ia": ("inteligencia", "artificial", "inteligencia artificial"),
    "inteligencia artificial": ("ia",),
    "covid": ("covid19", "coronavirus"),
    "pesquisa": ("estudo", "cientifico", "científica", "pesquisador", "pesquisadores"),
    "docente": ("professor", "professora"),
    "aluno": ("estudante", "graduando", "graduanda"),
    "ribeirao preto": ("campus ribeirao preto",),
    "esalq": ("escola superior de agricultura luiz de queiroz",),
    "fmrp": ("faculdade de medicina de ribeirao preto",),
    "iqsc": ("instituto de quimica de sao carlos",),
}

# Lines that are page furniture, matched on the lower-cased line.
NOISE_LINES = (r"^compartilhe:?$", r"^leia tamb[eé]m:?$", r"^veja tamb[eé]m:?$", r"^ou[cç]a:?$", r"^publicidade$")
#: Known residues of pages: a share-bar link, and the block that ends a page with a radio programme's name in bold, the
#: same name as a link, and the network it is on air on. More can be given to remove_boilerplate.
BOILERPLATE = (
    r"(?im)^\[Pular barra de compartilhamento\]\(\s*#main-content\s*\)\s*$",
    r"(?ims)^[ \t]*---[ \t]*\n\s*\*\*([^*\n]+)\*\*[ \t]*\n\s*\[\1\]\(https?://[^)\s]+\)\s+no ar veiculado pela Rede .*\Z",
)
INVISIBLE = "​‌‍⁠﻿"
# What UTF-8 looks like after a wrong decoding.
MOJIBAKE = ("Ã", "Â", "â€", "â€“", "â€”", "â€˜", "â€™", "â€œ", "â€�")


def _bare(c: str) -> str:
    return "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))


#: Latin letters with marks and compatibility signs that fold to one character.
_FOLD = {c: b for c in map(chr, range(0xA0, 0x250)) if len(b := _bare(c)) == 1 and b != c}
_MARKED, _PLAIN = "".join(_FOLD), "".join(_FOLD.values())


def strip_marks(text: Column) -> Column:
    """Without diacritics: Latin letters by a table, and combining marks of any script. General NFKD is fold_exact."""
    return F.regexp_replace(F.translate(text, _MARKED, _PLAIN), r"\p{M}+", "")


def tokenize(text: Column) -> Column:
    """array<string> of [a-z0-9]+ runs without marks, lower case; empty for null."""
    return F.regexp_extract_all(F.lower(strip_marks(F.coalesce(text, F.lit("")))), F.lit("[a-z0-9]+"), F.lit(0))


class _Plain(dict):
    """What a sign beyond ASCII leaves for tokens: its folded letter, nothing for a mark, else itself."""

    def __missing__(self, c: str) -> str:
        self[c] = out = (_FOLD.get(c) or ("" if unicodedata.category(c).startswith("M") else c)).lower()
        return out


_PLAIN_OF = _Plain()
_BEYOND, _TOKEN = re.compile(r"[^\x00-\x7f]"), re.compile("[a-z0-9]+")


def tokens_of(text: str | None) -> list[str]:
    """What tokenize() gives, in Python: for operators that count whole tables of texts, where it is ten times as fast."""
    if not text:
        return []
    if not text.isascii():
        text = _BEYOND.sub(lambda m: _PLAIN_OF[m[0]], text)
    return _TOKEN.findall(text.lower())


def drop_stopwords(tokens: Column, preset: str = "shipped") -> Column:
    stop = F.array(*map(F.lit, sorted(STOPWORDS[preset])))
    return F.filter(tokens, lambda t: ~F.array_contains(stop, t))


def query_terms(text: Column, preset: str = "shipped") -> Column:
    """Distinct thematic terms in the order of the question."""
    return F.array_distinct(drop_stopwords(tokenize(text), preset))


def expand_terms(terms: Column, synonyms: Mapping[str, Sequence[str]] = SYNONYMS) -> Column:
    """Each term followed by the tokens of its synonyms, distinct, in order."""
    if not synonyms:
        return F.array_distinct(terms)
    entry = lambda words: F.flatten(F.array(*[tokenize(F.lit(w)) for w in words]))
    table = F.create_map(*[x for k, words in synonyms.items() for x in (F.lit(k), entry(words))])
    return F.array_distinct(F.flatten(F.transform(terms, lambda t: F.concat(F.array(t), F.coalesce(F.try_element_at(table, t), F.array().cast("array<string>"))))))


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def squeeze(text: Column) -> Column:
    """Every run of white space as one space, none at the ends; single spaces are left alone."""
    return F.trim(F.regexp_replace(text, r"(?U) \s+|[\s&&[^ ]]\s*", " "))


def casefold(text: Column) -> Column:
    """Lower case with the sharp s and the final sigma folded, which covers the scripts that are used here."""
    return F.replace(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), F.lit("ς"), F.lit("σ"))


def text_identity(text: Column) -> Column:
    """Equal for texts that differ in case and white space only."""
    return casefold(squeeze(text))


def semantic_text(text: Column) -> Column:
    """Invisible characters dropped, white space squeezed; compatibility forms only by fold_exact."""
    return squeeze(F.translate(F.coalesce(text, F.lit("")), INVISIBLE, ""))


def _unlink(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(strip(text), r"^#{1,6}\s+", ""), r"\[([^\]]+)\]\([^)]+\)", "$1")


def paragraph_key(text: Column) -> Column:
    return casefold(semantic_text(F.regexp_replace(_unlink(text), r"[*_`]+", "")))


def editorial_key(text: Column) -> Column:
    return squeeze(F.regexp_replace(casefold(strip_marks(F.regexp_replace(_unlink(text), r"[\\*]", ""))), r"(?U)[^\w]+", " "))


def comparable_heading(text: Column) -> Column:
    return casefold(squeeze(F.regexp_replace(_unlink(text), r"\p{Cf}", "")))


def paragraph_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, "\n\n"), lambda p: strip(p) != ""))


#: The noise lines as one pattern over a line that is trimmed and short.
_NOISE_LINE = "(?iu)" + "|".join(NOISE_LINES)
_LONGEST_NOISE = 20


def is_noise_line(line: Column) -> Column:
    bare = strip(line)
    return (F.length(bare) <= _LONGEST_NOISE) & bare.rlike(_NOISE_LINE)


def remove_boilerplate(text: Column, patterns: Sequence[str] = BOILERPLATE) -> Column:
    for p in patterns:
        text = F.regexp_replace(text, p, "")
    return text


def normalize_markdown(text: Column) -> Column:
    """Clean Markdown: images and empty links go, white space is squeezed, noise lines go. Entities and wrongly
    decoded characters are repaired before by repair_exact where a text holds any."""
    plain = F.translate(F.replace(text, F.lit("\r\n"), F.lit("\n")), "\r\xa0\t", "\n  ")
    bracketed = F.regexp_replace(F.regexp_replace(plain, r"!\[[^\]]*]\([^)]*\)", ""), r"(?i)\[([^\]]+)]\(\s*(?:#|javascript:[^)]+)\)", "$1")
    spaced = F.regexp_replace(F.when(F.contains(text, F.lit("](")), bracketed).otherwise(plain), " {2,}", " ")
    kept = F.filter(F.transform(F.split(spaced, "\n"), _trim), lambda x: ~((F.length(x) <= _LONGEST_NOISE) & x.rlike(_NOISE_LINE)))
    # what a noise line leaves and what was there before become one blank line at most
    return F.btrim(F.regexp_replace(F.array_join(kept, "\n"), r"\n{3,}", "\n\n"), F.lit("\n"))


def _trim(line: Column) -> Column:
    """strip(), by a pattern only where something other than a space stands at an end."""
    bare = F.trim(line)
    return F.when(bare.rlike(r"(?U)^\s|\s$"), strip(bare)).otherwise(bare)


def clean_author(text: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(strip(text), r"(?i)^Por\s*", ""), r"^\*+|\*+$", ""))


def normalize_url(url: Column) -> Column:
    """Identity of an address: scheme and host in lower case, no utm_ parameters, no fragment, a path at least."""
    url = strip(F.coalesce(url, F.lit("")))
    bare = F.regexp_replace(url, r"(?s)#.*$", "")
    scheme, host = F.lower(F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)), F.lower(F.regexp_extract(bare, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?]*)", 1))
    rest = F.regexp_replace(bare, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?]*)?", "")
    path = F.regexp_replace(rest, r"(?s)\?.*$", "")
    query = F.regexp_extract(rest, r"(?s)\?(.*)$", 1)
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(p).startswith("utm_"))
    kept = F.transform(kept, lambda p: F.when(F.contains(p, F.lit("=")), p).otherwise(F.concat(p, F.lit("="))))
    joined = F.array_join(kept, "&")
    return F.concat(
        F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(F.lit("")),
        F.when(host != "", F.concat(F.lit("//"), host)).otherwise(F.lit("")),
        F.when(path == "", F.lit("/")).otherwise(path),
        F.when(joined != "", F.concat(F.lit("?"), joined)).otherwise(F.lit("")),
    )


def crawl_url(href: Column, base: str) -> Column:
    """Without fragment and query, absolute."""
    cut = F.regexp_replace(F.regexp_replace(href, r"(?s)#.*$", ""), r"(?s)\?.*$", "")
    root = base.rstrip("/")
    return F.when(cut.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), cut).when(cut.startswith("//"), F.concat(F.lit(root.split("//")[0]), cut)).when(cut.startswith("/"), F.concat(F.lit(root), cut)).otherwise(F.concat(F.lit(root + "/"), cut))


# Path segments of pages that are no articles.
SKIP_SEGMENTS = ("editorias", "tag", "category", "author", "page", "wp-content", "feed", "home-atualidades", "todas-as-noticias", "noticias")


def is_article_url(url: Column, site: str) -> Column:
    """An address of the site (or a relative one) with two path segments or more, none of them a listing's."""
    host = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)
    path = F.regexp_replace(F.regexp_replace(F.regexp_replace(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?", ""), r"(?s)[?#].*$", ""), r"^/+|/+$", "")
    segments = F.split(path, "/")
    return ((host == "") | F.contains(host, F.lit(site))) & (path != "") & ~F.arrays_overlap(segments, F.array(*map(F.lit, SKIP_SEGMENTS))) & (F.size(segments) >= 2)


def safe_pdf_name(name: Column, default: str = "documento.pdf") -> Column:
    clean = F.regexp_replace(F.regexp_replace(F.coalesce(name, F.lit("")), r"[^A-Za-z0-9_.-]", "_"), r"^[._]+|[._]+$", "")
    return F.when(clean == "", F.lit(default)).when(F.lower(clean).endswith(".pdf"), clean).otherwise(F.concat(clean, F.lit(".pdf")))


def source_type(source_object: Column, explicit: Column, url: Column) -> Column:
    """json or pdf by the object's suffix, else a stated type, else the address' suffix, else unknown."""
    obj, kind, path = F.lower(F.coalesce(source_object, F.lit(""))), F.lower(F.coalesce(explicit, F.lit(""))), F.lower(F.regexp_replace(F.coalesce(url, F.lit("")), r"(?s)\?.*$", ""))
    return F.when(obj.endswith(".pdf"), F.lit("pdf")).when(obj.endswith(".json"), F.lit("json")).when(kind.isin("json", "pdf"), kind).when(path.endswith(".pdf"), F.lit("pdf")).when(path.endswith(".json"), F.lit("json")).otherwise(F.lit("unknown"))


def safe_truncate(text: Column, limit: Column) -> Column:
    """At most ``limit`` characters, back to the last sentence, line or word end in the second half."""
    short = F.regexp_replace(F.substring(text, F.lit(1), limit.cast("int")), r"(?U)\s+$", "")
    last = lambda sep: F.when(F.contains(short, F.lit(sep)), F.length(short) - F.instr(F.reverse(short), sep[::-1]) + 1 - len(sep)).otherwise(F.lit(-1))
    boundary = F.greatest(last(". "), last("\n"), last(" "))
    cut = F.regexp_replace(F.substring(short, F.lit(1), boundary.cast("int")), r"(?U)\s+$", "")
    return F.when(F.length(text) <= limit, text).when(boundary >= F.floor(limit / 2), cut).otherwise(short)


def pdf_keywords(value: Column) -> Column:
    """map of ``key=value;key=value``; parts without = or without a key are skipped, the last of equal keys wins."""
    parts = F.filter(F.split(F.coalesce(value, F.lit("")), ";"), lambda p: F.contains(p, F.lit("=")) & (strip(F.substring_index(p, "=", 1)) != ""))
    pairs = F.transform(parts, lambda p: F.struct(strip(F.substring_index(p, "=", 1)).alias("k"), strip(F.regexp_replace(p, r"(?s)^[^=]*=", "")).alias("v")))
    last = F.filter(pairs, lambda x, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs) - i - 1, F.lit(0))), lambda y: y["k"] == x["k"]))
    return F.map_from_entries(last)


def canonical_json(**fields: Column) -> Column:
    """JSON of string fields with sorted keys and no spaces, as the canonical hash wants it."""
    return F.to_json(F.struct(*[F.coalesce(fields[k], F.lit("")).alias(k) for k in sorted(fields)]))


def surrogate_id(identity: Column) -> Column:
    return F.concat(F.lit("site_"), F.substring(F.sha2(identity, 256), 1, 16))


def lineage_id(document_id: Column, sha: Column) -> Column:
    return F.concat(F.lit("silver:"), document_id, F.lit(":"), F.substring(sha, 1, 16))


# --- exact forms in Python, for texts that the expressions above don't cover -------------------------------------


@F.pandas_udf(StringType())
def fold_exact(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """NFKC without invisible characters."""
    drop = dict.fromkeys(map(ord, INVISIBLE))
    for s in texts:
        yield s.map(lambda t: unicodedata.normalize("NFKC", t).translate(drop), na_action="ignore")


def repair_mojibake(text: str) -> str:
    """The decoding with the fewest signs of a wrong one."""
    signs = lambda t: sum(map(t.count, MOJIBAKE))
    best = text
    for codec in ("latin1", "cp1252"):
        try:
            other = text.encode(codec).decode("utf-8")
        except UnicodeError:
            continue
        best = min(best, other, key=signs)
    return best


@F.pandas_udf(StringType())
def repair_exact(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Entities resolved and wrong decodings repaired."""
    for s in texts:
        yield s.map(lambda t: repair_mojibake(html.unescape(t)), na_action="ignore")
