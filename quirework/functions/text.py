"""Scalar text operators as column expressions: they run in the JVM and need no shuffle.

Null texts count as empty unless said otherwise.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import Column, functions as F

from . import vocabulary as V

#: White space as Python's str methods see it.
SPACE = r"[\s\x1c-\x1f]"
#: The same characters, one by one.
SPACES = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
# Java is fast on \p{Alnum}, which is ASCII here, and on classes that name ASCII characters one by one, not on ranges and mixed ones.
_WITHIN = "(?:[" + "".join(rf"\x{k:02x}" for k in range(128) if chr(k) not in V.SENTENCE_ENDS) + r"]++|[^\x00-\x7f。！？；]++)"
#: V.TOKEN for Java: nothing is kept to go back to, so that no length of text exhausts the stack. A CJK character is a sign.
_TOKEN = r"\p{Alnum}++(?:[-_']\p{Alnum}++)*+|(?U:\d+(?:\.\d+)?|[^\s])"
#: Text up to a sentence mark or line break, and the mark.
_SENTENCE = rf"{_WITHIN}*+(?:[.!?;\n]|[。！？；])|{_WITHIN}++"


def _text(text: Column | str) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column | str) -> Column:
    return F.regexp_replace(_text(text), f"(?U)^{SPACE}+|{SPACE}+$", "")


def strip_short(text: Column) -> Column:
    """strip() of a short text that isn't null: without a pattern, but with memory of eight times the text."""
    return F.trim(text, F.lit(SPACES))


def normalize_space(text: Column | str) -> Column:
    """Blanks to one space, three or more line breaks to two; stripped."""
    return strip(F.regexp_replace(F.regexp_replace(_text(text), r"[ \t]{2,}|\t", " "), r"\n{3,}", "\n\n"))


def normalize_line(text: Column | str) -> Column:
    return F.regexp_replace(strip(text), f"(?U){SPACE}+", " ")


def nfkc(text: Column | str) -> Column:
    """Unicode compatibility composition; ASCII texts aren't sent to Python, and the others a few at a time."""
    from unicodedata import normalize

    # rows come in batches of any size, but one text after the other is in Python's own form
    @F.arrow_udf("string")
    def compose(values: pa.Array) -> pa.Array:
        return pa.array((normalize("NFKC", v.as_py()) if v.is_valid else None for v in values), pa.string(), size=len(values))

    # a function in Python is evaluated for every row, so that a condition around it keeps nothing from it
    return F.coalesce(compose(F.when(_text(text).rlike(r"[^\x00-\x7F]"), _text(text))), _text(text))


def normalize_scientific(text: Column | str, compose: bool = True) -> Column:
    """NFKC (unless compose is off), hyphenated line ends joined, blanks squeezed; stripped."""
    whole = nfkc(text) if compose else _text(text)
    joined = F.regexp_replace(whole, r"(?U)([A-Za-z])-\s*\n\s*([a-z])", "$1$2")
    return normalize_space(joined)


def remove_citation_markers(text: Column | str) -> Column:
    out = F.regexp_replace(F.regexp_replace(_text(text), f"(?U){V.CITATION_NUMBERS}", ""), f"(?U){V.CITATION_AUTHORS}", "")
    return normalize_line(out)


def tokens(text: Column | str) -> Column:
    return F.regexp_extract_all(_text(text), F.lit(_TOKEN), F.lit(0))


def estimated_tokens(text: Column | str) -> Column:
    return F.size(tokens(text))


def cjk_characters(text: Column | str) -> Column:
    return F.regexp_extract_all(_text(text), F.lit(f"[{V.CJK}]"), F.lit(0))


def cjk_bigrams(text: Column | str) -> Column:
    """Pairs of neighbours inside each run of CJK characters."""
    runs = F.filter(F.regexp_extract_all(_text(text), F.lit(f"[{V.CJK}]+"), F.lit(0)), lambda r: F.length(r) > 1)
    return F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda k: F.substring(r, k, F.lit(2)))))


def contains_cjk(text: Column | str) -> Column:
    return _text(text).rlike(f"[{V.CJK}]")


def cjk_ratio(text: Column | str) -> Column:
    dense = F.regexp_replace(_text(text), f"(?U){SPACE}+", "")
    return F.when(F.length(dense) == 0, 0.0).otherwise(F.size(cjk_characters(dense)) / F.length(dense))


def domain_terms(text: Column | str, terms: list[str]) -> Column:
    """Each term as often as it occurs (without overlap); terms without CJK in any case."""
    parts, raw = [], _text(text)
    for term in dict.fromkeys(terms):
        cjk = re.search(f"[{V.py(V.CJK)}]", term)
        where, found = (raw, term) if cjk else (F.lower(raw), term.lower())
        times = (F.length(where) - F.length(F.replace(where, F.lit(found), F.lit("")))) / len(found)
        parts.append(F.array_repeat(F.lit(found), times.cast("int")))
    return F.concat(*parts) if parts else F.array().cast("array<string>")


def search_tokens(text: Column | str, tokenizer: str = "char", terms: list[str] | None = None, bigrams: bool = True) -> Column:
    """The bag of search terms: words in lower case, domain terms, single CJK characters (or, for other tokenizers, all
    search tokens again), CJK bigrams. Without a word segmenter, ``jieba`` means ``char``."""
    known = tokenizer.strip().lower() in {"jieba", "jieba_search", "char", "character", "cjk_char"}

    def bag(clean: Column) -> Column:
        words = F.regexp_extract_all(F.lower(clean), F.lit(V.WORD), F.lit(0))
        own = cjk_characters(clean) if known else F.regexp_extract_all(F.lower(clean), F.lit(V.SEARCH_TOKEN), F.lit(0))
        parts = [words, domain_terms(clean, terms or []), own] + ([cjk_bigrams(clean)] if bigrams else [])
        return F.filter(F.concat(*parts), lambda t: t != "")

    # the normalised text is bound once
    return let(normalize_space(text), bag)


def normalize_search_token(token: Column | str) -> Column:
    low = F.lower(strip(token))
    return F.when(contains_cjk(low), low).when(low.rlike(f"^(?:{V.WORD})$"), low).otherwise("")


def paragraphs(text: Column | str) -> Column:
    parts = F.filter(F.transform(F.split(_text(text), r"(?U)\n\s*\n+"), strip_short), lambda p: p != "")
    return let(parts, lambda p: F.when(F.size(p) > 0, p).otherwise(F.array(strip(text))))


def sentence_units(text: Column | str, bare=strip_short) -> Column:
    """Units that end after each sentence mark or line break, each made bare; a text without any has none."""
    parts = F.regexp_extract_all(_text(text), F.lit(_SENTENCE), F.lit(0))
    return F.filter(F.transform(parts, bare), lambda p: p != "")


def sentences(text: Column | str) -> Column:
    """The units of a text; one without any is its only unit."""
    return let(sentence_units(text), lambda u: F.when(F.size(u) > 0, u).otherwise(F.array(strip(text))))


def _is_cjk(character: Column) -> Column:
    """Whether one character is CJK: compared, as a pattern takes long where each token is asked."""
    ranges = re.findall(r"\\x\{(\w+)\}-\\x\{(\w+)\}", V.CJK)
    return reduce(or_, (character.between(F.lit(chr(int(low, 16))), F.lit(chr(int(high, 16)))) for low, high in ranges))


def _touch(a: Column, b: Column) -> Column:
    """Whether no space goes between two texts: after a sentence mark, before a trailing mark or beside CJK."""
    last, first = F.substring(a, -1, 1), F.substring(b, 1, 1)
    return last.isin(*V.SENTENCE_ENDS) | first.isin(*V.TRAILING_MARKS) | _is_cjk(last) | _is_cjk(first)


def join_text(left: Column, right: Column) -> Column:
    """Both stripped; no space after a sentence mark, before a trailing mark or beside CJK."""

    def joined(both: Column) -> Column:
        a, b = both["a"], both["b"]
        return F.when(a == "", b).when(b == "", a).when(_touch(a, b), F.concat(a, b)).otherwise(F.concat(a, F.lit(" "), b))

    return let(F.struct(strip(left).alias("a"), strip(right).alias("b")), joined)


def join_stripped(parts: Column) -> Column:
    """Stripped texts put together as join_text does, all at once."""
    spaced = lambda x: F.transform(x, lambda t, k: F.when((k == 0) | _touch(F.get(x, k - 1), t), t).otherwise(F.concat(F.lit(" "), t)))
    return let(F.filter(parts, lambda t: t != ""), lambda x: F.array_join(spaced(x), ""))


def join_tokens(parts: Column) -> Column:
    """Tokens (none empty) put together: no space before CJK or a trailing mark, after CJK or an opening mark."""

    def dense(before: Column, token: Column) -> Column:
        last = F.substring(before, -1, 1)
        return ((F.length(token) == 1) & _is_cjk(token)) | _is_cjk(last) | token.isin(*V.TRAILING_MARKS) | last.isin(*V.OPENING_MARKS)

    spaced = lambda x: F.transform(x, lambda t, k: F.when((k == 0) | dense(F.get(x, k - 1), t), t).otherwise(F.concat(F.lit(" "), t)))
    return strip(let(parts, lambda x: F.array_join(spaced(x), "")))


def split_long(text: Column | str, most: int) -> Column:
    """Slices of ``most`` tokens, put together again."""
    return let(tokens(text), lambda found: _slices(found, most))


def _slices(found: Column, most: int) -> Column:
    starts = F.when(F.size(found) == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), F.size(found), F.lit(most)))
    return F.transform(starts, lambda k: join_tokens(F.slice(found, k, F.lit(most))))


def boundary_units(text: Column | str, most: int) -> Column:
    """array<struct<text, reason>>: paragraphs that fit, else their sentences, else slices of tokens."""
    return F.transform(counted_units(text, most), lambda u: F.struct(u["text"].alias("text"), u["reason"].alias("reason")))


def counted_units(text: Column | str, most: int) -> Column:
    """Boundary units with n, their numbers of tokens; each text is counted once."""
    return _units(_counted(paragraphs(text)), most)


def _counted(texts: Column) -> Column:
    return F.transform(texts, lambda t: F.struct(t.alias("text"), estimated_tokens(t).alias("n")))


def _units(counted: Column, most: int) -> Column:
    unit = lambda t, reason, n: F.struct(t.alias("text"), F.lit(reason).alias("reason"), n.alias("n"))

    def of_sentence(s: Column) -> Column:
        cut = lambda found: F.transform(_slices(found, most), lambda t: unit(t, "hard_limit", estimated_tokens(t)))
        return let(tokens(s), lambda found: F.when(F.size(found) <= most, F.array(unit(s, "sentence_boundary", F.size(found)))).otherwise(cut(found)))

    def of_paragraph(p: Column) -> Column:
        return F.when(p["n"] <= most, F.array(unit(p["text"], "paragraph_boundary", p["n"]))).otherwise(F.flatten(F.transform(sentences(p["text"]), of_sentence)))

    return F.flatten(F.transform(counted, of_paragraph))


def trailing_overlap(text: Column | str, budget: int) -> Column:
    """The longest suffix of whole sentences within the budget, else the last tokens."""
    if budget <= 0:
        return F.lit("")
    start = F.struct(F.lit("").alias("out"), F.lit(False).alias("full"))

    def step(state: Column, sentence: Column) -> Column:
        longer = F.when(state["out"] == "", sentence).otherwise(join_text(sentence, state["out"]))
        full = state["full"] | (estimated_tokens(longer) > budget)
        return F.struct(F.when(full, state["out"]).otherwise(longer).alias("out"), full.alias("full"))

    whole = F.aggregate(F.reverse(sentences(text)), start, step, lambda s: s["out"])
    last = let(tokens(text), lambda t: join_tokens(F.slice(t, F.greatest(F.size(t) - budget + 1, F.lit(1)), F.lit(budget))))
    return let(whole, lambda w: F.when(w != "", w).otherwise(last))


def combined_reason(reasons: Column) -> Column:
    has = lambda r: F.array_contains(reasons, r)
    rest = F.filter(reasons, lambda r: r != "overlap")
    named = F.when(has("hard_limit"), "hard_limit").when(has("sentence_boundary"), "sentence_boundary").when(has("paragraph_boundary"), "paragraph_boundary")
    return F.when(F.size(rest) == 0, "within_limit").otherwise(F.coalesce(named, F.try_element_at(rest, F.lit(-1))))


def split_text(text: Column | str, most: int, overlap: int = 0) -> Column:
    """array<struct<text, reason>>: boundary units packed greedily into pieces of at most ``most`` tokens.

    With an overlap, a piece begins with the last piece's trailing sentences (or tokens) of that many tokens, unless
    they and the next unit exceed the limit while the unit alone doesn't.

    A unit's tokens are counted once, and a piece's count is the sum of its units': units are put together without a
    space only after a sentence mark, before a trailing mark or beside CJK, where no token goes on.
    """
    state = "struct<out:array<struct<head:string,first:int,at:int>>,head:struct<text:string,n:int>,first:int,at:int,n:int,some:boolean>"
    start = F.from_json(F.lit('{"out":[],"head":{"text":"","n":0},"first":0,"at":0,"n":0,"some":false}'), state)
    none = F.struct(F.lit("").alias("text"), F.lit(0).alias("n"))

    def packed(units: Column) -> Column:
        """Places of pieces are found first, so that texts aren't copied from state to state."""
        own = lambda p: F.slice(units, p["first"] + 1, p["at"] - p["first"])
        place = lambda s: F.struct(s["head"]["text"].alias("head"), s["first"].alias("first"), s["at"].alias("at"))
        text_of = lambda p: join_stripped(F.concat(F.array(p["head"]), F.transform(own(p), lambda u: u["text"])))

        def begun(s: Column, unit: Column) -> Column:
            """The head of the next piece."""
            last = let(trailing_overlap(text_of(place(s)), overlap), lambda o: F.struct(o.alias("text"), estimated_tokens(o).alias("n")))
            return let(last, lambda k: F.when((k["n"] + unit["n"] <= most) | (unit["n"] > most), k).otherwise(none)) if overlap > 0 else none

        def step(s: Column, unit: Column) -> Column:
            then = lambda out, head, first, n, some: F.struct(out.alias("out"), head.alias("head"), first.alias("first"), (s["at"] + 1).alias("at"), (n + unit["n"]).alias("n"), (some | (unit["text"] != "")).alias("some"))
            full = (s["some"] | (s["head"]["text"] != "")) & (s["head"]["n"] + s["n"] + unit["n"] > most)
            next_one = then(F.concat(s["out"], F.array(place(s))), begun(s, unit), s["at"], F.lit(0), F.lit(False))
            return F.when(full, next_one).otherwise(then(s["out"], s["head"], s["first"], s["n"], s["some"]))

        def ended(s: Column) -> Column:
            return F.when(s["some"] | (s["head"]["text"] != ""), F.concat(s["out"], F.array(place(s)))).otherwise(s["out"])

        piece = lambda p: F.struct(text_of(p).alias("text"), combined_reason(F.transform(own(p), lambda u: u["reason"])).alias("reason"))
        return F.transform(F.aggregate(units, start, step, ended), piece)

    empty = F.array().cast("array<struct<text:string,reason:string>>")

    def split(c: Column, counted: Column) -> Column:
        # no token goes across paragraphs, so the whole has as many at least
        n = F.aggregate(counted, F.lit(0), lambda a, p: a + p["n"])
        fits = F.when(n > most, False).otherwise(estimated_tokens(c) <= most)
        whole = F.array(F.struct(c.alias("text"), F.lit("within_limit").alias("reason")))
        return F.when(fits, whole).otherwise(let(_units(counted, most), packed))

    return let(normalize_space(text), lambda c: F.when(c == "", empty).otherwise(let(_counted(paragraphs(c)), lambda counted: split(c, counted))))


def mojibake_score(text: Column | str, extra: str = "") -> Column:
    """Signs of a broken encoding: replacement and private-use characters, (cid:n), controls, known glyphs and ``extra``."""
    glyphs = "".join("\\" + c if c in r"\]^-[&" else c for c in V.GLYPHS + extra)
    signs = r"\(cid:\d+\)|[\x{fffd}\x{e000}-\x{f8ff}\x{00}-\x{08}\x{0b}\x{0c}\x{0e}-\x{1f}\x{80}-\x{9f}]"
    return F.regexp_count(_text(text), F.lit(signs)) + F.regexp_count(_text(text), F.lit(f"[{glyphs}]"))


def stable_id(prefix: str, *parts: Column) -> Column:
    """prefix_ and 24 hex digits of the SHA-256 of the parts' lines; a null part is the word None."""
    lines = F.concat_ws("\n", *(F.coalesce(p.cast("string"), F.lit("None")) for p in parts))
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(lines, 256), 1, 24))


def content_hash(text: Column | str) -> Column:
    return F.sha2(_text(text), 256)


def page_label(start: Column, end: Column) -> Column:
    one, two = start.cast("string"), end.cast("string")
    return F.when(start.isNull() & end.isNull(), "").when(end.isNull() | (start == end), one).when(start.isNull(), two).otherwise(F.concat(one, F.lit("-"), two))


def contextualized(title: Column, source_type: Column, section: Column, page: Column, text: Column) -> Column:
    """A chunk's text under its header, as it is embedded and indexed."""
    head = lambda name, value: F.concat(F.lit(f"{name}: "), value)
    return F.concat_ws("\n", head("Title", title), head("Source type", source_type), head("Section", section), F.when(page != "", head("Page", page)), F.lit("Content:"), strip(text))


def asset_label(caption: Column, block_type: Column, index: Column) -> Column:
    name = F.when(block_type == "figure", "Figure").when(block_type == "table", "Table").when(block_type == "equation", "Equation").otherwise("Asset")
    found = F.nullif(F.regexp_extract(_text(caption), f"(?iU){V.ASSET_LABEL}", 0), F.lit(""))
    return F.coalesce(found, F.concat(name, F.lit(" "), index.cast("string")))


def heading_level(block_type: Column, text: Column) -> Column:
    number = F.regexp_extract(strip(text), r"(?U)^(\d+(?:\.\d+)*)", 1)
    depth = F.when(number == "", 2).otherwise(F.least(F.size(F.split(number, r"\.")), F.lit(6)))
    return F.when(block_type == "title", 1).when(block_type == "section_header", depth).otherwise(0)


def normalize_heading(text: Column | str) -> Column:
    plain = F.regexp_replace(strip(F.lower(_text(text))), f"(?U){V.HEADING_NUMBER}", "")
    return normalize_line(F.regexp_replace(plain, r"[^a-z0-9\x{4e00}-\x{9fff}]+", " "))


def is_common_heading(text: Column | str) -> Column:
    plain = F.regexp_replace(F.lower(strip(text)), f"(?U){V.COMMON_HEADING_NUMBER}", "")
    return strip(F.regexp_replace(plain, r"[^a-z0-9\x{4e00}-\x{9fff}]+", " ")).isin(*V.COMMON_HEADINGS)


def front_matter(text: Column | str) -> Column:
    """struct<body, metadata map>: the fenced key: value lines before a text; of equal keys the last counts."""
    fence = r"(?sU)^---\s*\n(.*?)\n---\s*\n(.*)$"
    head, body = F.regexp_extract(_text(text), fence, 1), F.regexp_extract(_text(text), fence, 2)
    lines = F.filter(F.split(head, "\n"), lambda line: line.contains(":"))
    pairs = F.transform(
        lines, lambda line: F.struct(strip(F.substring_index(line, ":", 1)).alias("k"), F.trim(strip(F.regexp_replace(line, "^[^:]*:", "")), F.lit('"')).alias("v"))
    )
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"] == p["k"]))
    found = _text(text).rlike(fence)
    return F.struct(F.when(found, body).otherwise(_text(text)).alias("body"), F.when(found, F.map_from_entries(last)).otherwise(F.from_json(F.lit("{}"), "map<string,string>")).alias("metadata"))


def token_set(text: Column | str) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(_text(text)), F.lit(r"[a-z0-9\x{4e00}-\x{9fff}]+"), F.lit(0)))


def overlap(part: Column, whole: Column) -> Column:
    """The share of a text's distinct tokens that the other has too."""
    return overlap_of(token_set(part), token_set(whole))


def overlap_of(a: Column, b: Column) -> Column:
    """The share of the first set's tokens that the second has too."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def lenient_json(raw: Column, schema: str) -> Column:
    """The object that a text is, or that stands between its first { and last }; null if neither parses."""
    whole = lambda c: F.when(F.get_json_object(c, "$").isNotNull(), F.from_json(c, schema))
    return F.coalesce(whole(raw), whole(F.regexp_extract(raw, r"(?s)\{.*\}", 0)))


def list_items(text: Column | str, most: int) -> Column:
    """Lines without bullets, numbers and quotes, at most ``most``; without any, the sentences."""
    bare = F.transform(F.split(_text(text), r"\r\n|[\n\r]"), lambda line: F.trim(strip(F.regexp_replace(line, r"(?U)^\s*(?:[-*•]|\d+[.)、])\s*", "")), F.lit("\"'` ")))
    items = F.filter(bare, lambda i: (i != "") & ~i.rlike("^(" + "|".join(V.ITEM_PREFIXES) + ")"))
    parts = F.filter(F.transform(F.split(_text(text), r"[。；;\n]+"), strip), lambda p: p != "")
    return let(items, lambda x: F.slice(F.when(F.size(x) > 0, x).otherwise(parts), F.lit(1), F.lit(most)))


def file_name(name: Column | str) -> Column:
    safe = F.regexp_replace(strip(name), r'(?U)[<>:"/\\|?*\s]+', "_")
    return F.coalesce(F.nullif(F.regexp_replace(safe, r"^[._]+|[._]+$", ""), F.lit("")), F.lit("file"))


def result_key(method: str, **params) -> str:
    if method == "vector":
        return "vector_g={g}_Nx={Nx}_Nz={Nz}".format(**params)
    if method == "cnn":
        return "cnn"
    if method == "bnn":
        return "bnn_MC_test={MC_test}".format(**params)
    raise ValueError(f"Unknown result method: {method}")


def context_block(citation: Column, title: Column, page: Column, section: Column, text: Column) -> Column:
    """One document of a prompt's context."""
    known = lambda c: F.when(_text(c) == "", "unknown").otherwise(c)
    return F.concat(F.lit("["), citation, F.lit("]\nTitle: "), F.coalesce(title, F.lit("unknown")), F.lit("\nPage: "), known(page), F.lit("\nSection: "), known(section), F.lit("\nContent:\n"), strip(text))
