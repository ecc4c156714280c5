"""Boolean operators on texts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import vocabulary as V
from .text import SPACE, _text, mojibake_score, normalize_heading, normalize_line, strip

HEADINGS = ("title", "section_header")
ASSETS = ("figure", "table", "equation")
DROPPED_ROLES = ("reference", "furniture", "noise")


def _is(text: Column, pattern: str) -> Column:
    return text.rlike(V.IU + pattern)


def is_reference_heading(text: Column | str) -> Column:
    return _is(normalize_line(text), V.REFERENCE_HEADING)


def is_reference_path(path: Column | str) -> Column:
    """Any part of a section path, or its end, names a list of references."""
    line = normalize_line(path)
    parts = F.split(line, r"(?U)>\s*")
    return (line != "") & (F.exists(parts, lambda p: _is(strip(p), V.REFERENCE_HEADING)) | _is(line, V.REFERENCE_SECTION))


def is_reference_section(path: Column | str) -> Column:
    return F.exists(F.split(_text(path), ">"), lambda p: normalize_heading(p).isin(*V.REFERENCE_NAMES))


def is_title_noise(text: Column | str) -> Column:
    return _is(normalize_line(text), V.TITLE_NOISE)


def is_publication_header(text: Column | str) -> Column:
    line = normalize_line(text)
    short = (F.length(line) <= 140) & line.contains("第") & line.contains("卷") & line.contains("期")
    return (line != "") & (_is(line, V.PUBLICATION_HEADER) | short)


def candidate_lines(text: Column | str) -> Column:
    """Non-blank stripped lines."""
    return F.filter(F.transform(F.split(_text(text), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"), strip), lambda x: x != "")


def is_bibliography(text: Column | str) -> Column:
    """At least four marks of citations, or three lines of which 60 % have one, in 80 characters or more."""
    line, lines = normalize_line(text), candidate_lines(text)
    cited = F.size(F.filter(lines, lambda x: _is(normalize_line(x), V.BIBLIOGRAPHY_MARKER)))
    many = F.regexp_count(line, F.lit(V.IU + V.BIBLIOGRAPHY_MARKER)) >= 4
    return (F.length(line) >= 80) & (many | ((F.size(lines) >= 3) & (cited / F.size(lines) >= 0.6)))


def is_supplement_license(text: Column | str) -> Column:
    line = normalize_line(text)
    return _is(line, V.SUPPLEMENT_LICENSE) & ~_is(line, V.SUPPLEMENT_CONTENT)


def is_front_matter(text: Column | str) -> Column:
    line = normalize_line(text)
    words = F.regexp_count(line, F.lit(r"[A-Za-z\x{4e00}-\x{9fff}]+"))
    small = (F.length(line) <= 260) & _is(line, V.FRONT_MATTER) & (words <= 35)
    return (line != "") & (is_publication_header(line) | _is(line, V.DATE_ONLY) | is_supplement_license(line) | small)


def drop_reason(text: Column | str, path: Column | str | None = None, cleaning: bool = True, without_references: bool = True) -> Column:
    """Why a chunk stays out of the index: empty, reference_section, bibliography_like, front_matter_or_header; else null."""
    if not cleaning:
        return F.lit(None).cast("string")
    out = F.when(normalize_line(text) == "", "empty")
    if without_references:
        if path is not None:
            out = out.when(is_reference_path(path), "reference_section")
        out = out.when(is_bibliography(text), "bibliography_like")
    return out.when(is_front_matter(text), "front_matter_or_header")


def is_platform_metadata(text: Column | str) -> Column:
    return _is(normalize_line(text), V.PLATFORM_METADATA)


def is_recommendation_heading(text: Column | str) -> Column:
    return _is(normalize_line(text), V.RECOMMENDATION_HEADING)


def is_academic_heading(text: Column | str, block_type: Column) -> Column:
    line = normalize_line(text)
    return ~F.coalesce(block_type.isin(*HEADINGS), F.lit(False)) & (F.length(line) <= 80) & _is(line, V.ACADEMIC_HEADING)


def is_noise_line(line: Column | str) -> Column:
    return _is(normalize_line(line), V.NOISE_LINE)


def is_repeatable_line(line: Column | str) -> Column:
    """A line that may be a running header: at most 180 characters and 18 words."""
    clean = normalize_line(line)
    return (clean != "") & (F.length(clean) <= 180) & (F.size(F.split(clean, " ")) <= 18)


def is_main_role(role: Column) -> Column:
    return ~F.coalesce(role, F.lit("body")).isin(*DROPPED_ROLES)


def is_nested_path(a: Column, b: Column) -> Column:
    one, two = strip(a), strip(b)
    return (one != "") & (two != "") & (one != two) & (two.startswith(F.concat(one, F.lit(" > "))) | one.startswith(F.concat(two, F.lit(" > "))))


def is_heading_only(text: Column | str, path: Column | str) -> Column:
    return (normalize_line(text) != "") & (normalize_line(text) == normalize_line(path))


def has_quality_blockers(*counters: Column) -> Column:
    return F.greatest(*(F.coalesce(c, F.lit(0)) for c in counters), F.lit(0)) > 0


def is_mojibake(text: Column | str, extra: str = "") -> Column:
    score = mojibake_score(text, extra)
    return (F.length(_text(text)) > 0) & ((score >= 20) | (score / F.greatest(F.length(_text(text)), F.lit(1)) >= 0.02))


def is_yes(value: Column | str) -> Column:
    return F.lower(strip(F.col(value).cast("string") if isinstance(value, str) else value.cast("string"))).isin(*V.YES)


def falls_back_to_chat(error: Column, n_documents: Column, generation: Column) -> Column:
    low = F.lower(_text(generation))
    marked = F.lit(False)
    for marker in V.FALLBACK_MARKERS:
        marked = marked | low.contains(marker)
    return (_text(error) != "") | (F.coalesce(n_documents, F.lit(0)) == 0) | marked


def needs_clarification(text: Column | str) -> Column:
    bare = strip(F.regexp_replace(strip(text), r"(?iu)^(?:deep\s*research|deep_research)[:：]?", ""))
    return F.lower(bare).isin(*V.VAGUE_REQUESTS) | (F.length(bare) <= 3)


def contains_any(text: Column, words) -> Column:
    out = F.lit(False)
    for word in words:
        out = out | text.contains(word)
    return out


def route(text: Column | str, has_files: Column | None = None) -> Column:
    """The route that a message's words choose; null if none."""
    low, files = F.lower(_text(text)), F.lit(False) if has_files is None else F.coalesce(has_files, F.lit(False))
    knows, computes = contains_any(low, V.KNOWLEDGE_WORDS), contains_any(low, V.COMPUTE_WORDS)
    hit = {name: contains_any(low, words) for name, words in V.ROUTES.items()}
    return F.when(hit["self_rag"], "self_rag").when(hit["strain_estimation"] & (~knows | computes) & (files | computes), "strain_estimation").when(hit["deep_research"], "deep_research")


def is_memory_command(text: Column | str) -> Column:
    bare = strip(text)
    return bare.startswith("记住") | bare.startswith("忘记") | bare.contains("查看记忆") | bare.contains("清除摘要")


def supervised_route(text: Column, requested: Column, pending: Column, has_method: Column, has_files: Column) -> Column:
    """Request, pending research, method with files, memory command, words, then the knowledge base."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    return (
        F.when(_text(requested) != "", requested)
        .when(yes(pending), "deep_research")
        .when(yes(has_method) & yes(has_files), "strain_estimation")
        .when(is_memory_command(text), "chat")
        .otherwise(F.coalesce(route(text, has_files), F.lit("self_rag")))
    )


FORMATS = ("pdf", "docx", "txt", "md")


def source_format(path: Column | str) -> Column:
    """The supported format of a path's suffix (pdf, docx, txt, md); null for any other."""
    suffix = F.lower(F.regexp_extract(_text(path), r"\.([^./\\]+)$", 1))
    return F.when(suffix.isin(*FORMATS), suffix)


def matches_glob(path: Column | str, glob: str) -> Column:
    """A glob against the whole path, its last part or (with a slash) any tail; * crosses slashes."""
    import fnmatch

    def regex(pattern: str) -> str:
        out = fnmatch.translate(pattern)
        return out.replace(r"\Z", r"\z").replace(r"(?s:", "(?s:")

    p = _text(path)
    out = p.rlike("^" + regex(glob)) | F.substring_index(p, "/", -1).rlike("^" + regex(glob))
    if "/" in glob and not glob.startswith("/"):
        out = out | p.rlike("^" + regex("*/" + glob))
    return out


__all__ = [n for n in dir() if not n.startswith("_") and n not in ("annotations", "Column", "F", "V", "SPACE")]
