"""Column functions on texts, paths and ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """``body(value)`` with value computed once per row, however often body uses it; the optimizer doesn't spread it either."""
    return F.transform(F.array(value), body)[0]


def strip(text: Column) -> Column:
    """Without white space (also Unicode's) at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def sanitize(text: Column) -> Column:
    """Letters, digits, - and _ stay, all else becomes _; _ goes at both ends; item if nothing stays."""
    made = F.trim(F.regexp_replace(text, r"[^\p{L}\p{N}_-]", "_"), F.lit("_"))
    return F.when(made == "", "item").otherwise(made)


def sample_id(*parts: Column) -> Column:
    return F.concat_ws("__", F.lit("inserted"), *[sanitize(p) for p in parts])


def name(path: Column) -> Column:
    return F.element_at(F.split(F.rtrim(path, F.lit("/")), "/"), -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(name(path), r"(?<=.)\.[^.]+$", "")


def frame_directory(path: Column, width: int = 40) -> Column:
    """A short readable folder name: the sanitized stem's start and 12 digits of the path's SHA-1."""
    return F.concat(F.rtrim(F.substring(sanitize(stem(path)), 1, width), F.lit("_")), F.lit("_"), F.left(F.sha1(path), F.lit(12)))


def path_variants(path: Column, anchors: tuple[str, ...] = ("full", "videos", "target", "dataset")) -> Column:
    """Distinct ways to name a path, most specific first: itself, its name, its stem, and from each anchor folder on."""
    plain = F.regexp_replace(strip(path), r"\\", "/")
    parts = F.split(plain, "/")
    from_anchor = [
        F.when(F.array_contains(parts, a), F.array_join(F.slice(parts, F.array_position(parts, a).cast("int"), F.size(parts)), "/")) for a in anchors
    ]
    made = F.array(plain, name(plain), stem(plain), *from_anchor)
    return F.array_distinct(F.filter(made, lambda v: v.isNotNull() & (v != "")))


def parent_group(path: Column, fallback: Column, generic: tuple[str, ...]) -> Column:
    """The last two folders of the path that are not generic, joined by " / "."""
    parts = F.filter(F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0))), lambda p: (p != "") & ~F.lower(p).isin(*generic))
    kept = F.when(F.size(parts) > 2, F.slice(parts, F.size(parts) - 1, 2)).otherwise(parts)
    return F.when(F.coalesce(F.size(kept), F.lit(0)) > 0, F.array_join(kept, " / ")).otherwise(fallback)


def tokens(text: Column) -> Column:
    """Distinct lower-case words of a-z and 0-9."""
    return F.array_distinct(F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: t != ""))


def has_marker(markers: tuple[str, ...], *texts: Column) -> Column:
    wanted = F.array(*map(F.lit, markers))
    found = F.lit(False)
    for t in texts:
        found = found | F.coalesce(F.arrays_overlap(tokens(t), wanted), F.lit(False))
    return found


#: What stands before a model's answer, in order of preference.
ANSWER_MARKERS = ("<SPECIAL_11>Assistant", "Assistant\n")


def after_marker(text: Column, markers: tuple[str, ...] = ANSWER_MARKERS) -> Column:
    """What follows the last place of the first listed marker that occurs, without empty think tags and outer white space."""
    made = text
    for m in reversed(markers):
        made = F.when(text.contains(m), F.substring_index(text, m, -1)).otherwise(made)
    return strip(F.replace(made, F.lit("<think></think>"), F.lit("")))


def clip_range(path: Column) -> Column:
    """(start, end) of a name like 12_30.mp4; null unless end > start."""
    pattern = r"(\d+)_(\d+)\.mp4\z"
    s, e = (F.nullif(F.regexp_extract(path, pattern, g), F.lit("")).cast("double") for g in (1, 2))
    return F.when(e > s, F.struct(s.alias("s"), e.alias("e")))


def full_path(path: Column) -> Column:
    """The whole recording that an annotated path belongs to: itself below dataset/full, by its folder below dataset/clip, else null."""
    parts = F.split(path, "/")
    n, part = F.size(parts), lambda i: F.get(parts, i)
    clip = F.concat(F.lit("dataset/full/"), part(2), F.lit("/target/"), F.try_element_at(parts, F.lit(-2)), F.lit(".mp4"))
    known = (n >= 5) & (part(0) == "dataset")
    return F.when(known & (part(1) == "full"), path).when(known & (part(1) == "clip"), clip)


def absolute_path(root: str, path: Column) -> Column:
    """The path below root; a leading dataset/ stands for root."""
    return F.concat(F.lit(root.rstrip("/") + "/"), F.regexp_replace(path, r"\Adataset/", ""))


def path_sample_id(path: Column) -> Column:
    return F.concat(F.get(F.split(path, "/"), 2), F.lit("__"), stem(path))


def is_canonical(folder: Column) -> Column:
    """Annotation folders of the plain kind. The endings of the others are fixed values."""
    return ~folder.rlike(r"(_adaptive|_binary|_qa)\z")


def percent(x: Column) -> Column:
    return F.format_string("%.1f%%", x * 100)


def slug(text: Column, default: str = "plot") -> Column:
    made = F.trim(F.regexp_replace(F.lower(strip(text)), "[^a-z0-9]+", "_"), F.lit("_"))
    return F.when(made == "", default).otherwise(made)


def interval_title(s: Column, e: Column, names: Column) -> Column:
    """``1.00s - 2.50s | a, b``."""
    shown = F.when(F.size(names) > 0, F.array_join(names, ", ")).otherwise(F.lit("Unknown category"))
    return F.concat(F.format_string("%.2fs - %.2fs | ", s, e), shown)


def option_title(parent: Column, video: Column, n_left: Column, n_right: Column, n_gt: Column, gap: Column, names: tuple[str, str] = ("left", "right")) -> Column:
    return F.format_string(f"%s | %s | {names[0]} %d | {names[1]} %d | GT %d | gap %.3f", parent, video, n_left, n_right, n_gt, gap)


def quoted(path: Column) -> Column:
    """Percent-encoded, but for the slashes."""
    return F.replace(F.replace(F.replace(F.url_encode(path), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/")), F.lit("%7E"), F.lit("~"))


def http_url(path: Column, root: str, host: str, port: int) -> Column:
    """The url of a file below root; null for others."""
    base = root.rstrip("/") + "/"
    return F.when(path.startswith(base), F.concat(F.lit(f"http://{host}:{port}/"), quoted(F.substring(path, len(base) + 1, 1 << 30))))


def file_url(path: Column) -> Column:
    return F.concat(F.lit("file://"), quoted(path))


def data_url(content: Column, path: Column) -> Column:
    kind = F.when(F.lower(path).rlike(r"\.jpe?g\z"), "image/jpeg").otherwise("image/png")
    text = F.replace(F.base64(content), F.lit("\r\n"), F.lit(""))  # Spark may cut it into lines of 76 signs
    return F.concat(F.lit("data:"), kind, F.lit(";base64,"), text)


def common_root(path: Column) -> Column:
    """Aggregate: the folders that all paths share. They are those that the first and the last path share."""
    a, b = F.split(F.min(path), "/"), F.split(F.max(path), "/")
    same = F.transform(F.sequence(F.lit(1), F.least(F.size(a), F.size(b))), lambda n: F.slice(a, F.lit(1), n) == F.slice(b, F.lit(1), n))
    return F.array_join(F.slice(a, F.lit(1), F.size(F.filter(same, lambda x: x))), "/")


def boxed_sections(text: str, names: tuple[str, ...], defaults: dict[str, str] | None = None) -> dict[str, str]:
    """By name: the section ``<box> .. </box>`` of a prompt that starts with ``name:``, else its default."""
    import re

    found = {n: v for n, v in (defaults or {}).items() if n in names}
    for n in names:
        if m := re.search(rf"<box>\n({re.escape(n)}:.*?)\n</box>", text, re.S):
            found[n] = m[1].strip()
    return found


def last_lines(raw: Column, n: int) -> Column:
    """The last n lines of a text."""
    lines = F.split(F.regexp_replace(raw, r"\r?\n\z", ""), r"\r?\n")
    return F.array_join(F.slice(lines, F.greatest(F.size(lines) - n + 1, F.lit(1)), F.lit(n)), "\n")
