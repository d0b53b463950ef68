"""Paths, include targets, scopes of a workspace and languages as column expressions."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from cairn.functions.names import lower_ascii

# Languages by extension, directories that are left out, marker files of projects.
LANGUAGE_OF = {"c": "c", "h": "c", "cc": "cpp", "cpp": "cpp", "cxx": "cpp", "hh": "cpp", "hpp": "cpp", "hxx": "cpp", "inl": "cpp", "go": "go"}
EXCLUDED_DIRS = (".git", ".vscode", "node_modules", "target", "out", "build")
MARKERS = ("makefile", "gnumakefile", "cmakelists.txt", "build.ninja", "meson.build", "build", "build.bazel", "workspace", "workspace.bazel", "go.mod", "go.work")
MARKER_SUFFIXES = (".pro", ".sln", ".vcxproj", ".vcproj")


def extension(path: Column) -> Column:
    """Extension in lower case, empty without one."""
    return lower_ascii(F.regexp_extract(path, r"[^/]\.([^./]*)$", 1))


def basename(path: Column) -> Column:
    """Last segment."""
    return F.regexp_extract(path, r"([^/]*)$", 1)


def dirname(path: Column) -> Column:
    """All segments but the last, empty at the top."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def include_form(text: Column) -> Column:
    """quote or angle, by the first delimiter, if the target is well formed."""
    first = F.regexp_extract(text, r'^[^"<]*(["<])', 1)
    return F.when(include_path(text).isNotNull(), F.when(first == '"', "quote").otherwise("angle"))


def include_path(text: Column) -> Column:
    """Target of an include with forward slashes; null without a well-formed one."""
    p = F.translate(F.trim(F.coalesce(F.nullif(F.regexp_extract(text, r'^[^"<]*"([^"]*)"', 1), F.lit("")), F.regexp_extract(text, r"^[^\"<]*<([^>]*)>", 1))), "\\", "/")
    return F.when(p != "", p)


def relative_slash_path(path: Column, root: Column) -> Column:
    """Path below a root with forward slashes; null outside of it."""
    p, r = F.translate(path, "\\", "/"), F.regexp_replace(F.translate(root, "\\", "/"), "/+$", "")
    return F.when(F.startswith(p, F.concat(r, F.lit("/"))), F.substr(p, F.length(r) + 2))


def normalized_path(path: Column) -> Column:
    """Forward slashes, none doubled, none at the end."""
    return F.regexp_replace(F.regexp_replace(F.translate(path, "\\", "/"), "/{2,}", "/"), "(?<=.)/$", "")


def digest(*parts: Column, length: int = 24) -> Column:
    """Opaque identity: leading hex characters of a hash of the parts, nulls apart from empty ones."""
    coded = [F.coalesce(F.concat(F.lit("="), p.cast("string")), F.lit("-")) for p in parts]
    return F.substring(F.sha2(F.concat_ws("\0", *coded), 256), 1, length)


def in_scope(path: Column, include: Sequence[str] = (), exclude: Sequence[str] = (), extensions: Sequence[str] = tuple(LANGUAGE_OF), excluded_dirs: Sequence[str] = EXCLUDED_DIRS) -> Column:
    """Whether a relative path belongs to the workspace; prefixes and directories are compared without letter case, exclusion goes first."""
    low = lower_ascii(path)
    below = lambda prefix: (low == prefix.lower().strip("/")) | F.startswith(low, F.lit(prefix.lower().strip("/") + "/"))
    ok = extension(path).isin([e.lower() for e in extensions])
    if include:
        ok &= F.greatest(*[below(p) for p in include]) if len(include) > 1 else below(include[0])
    for p in exclude:
        ok &= ~below(p)
    if excluded_dirs:
        ok &= ~low.rlike("(^|/)(" + "|".join(re.escape(d.lower()) for d in excluded_dirs) + ")/")
    return ok


def glob_pattern(glob: str) -> str:
    """Regular expression of a glob: ``**`` over directories, ``*`` and ``?`` within one."""
    out = ""
    for part in re.split(r"(\*\*/?|\*|\?)", glob):
        out += {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(part, re.escape(part))
    return f"^{out}$"


def ignore_rules(files: Sequence[tuple[str, str]]) -> list[tuple[str, bool, bool]]:
    """``(regular expression of paths, whether it ignores, for directories only)`` of ignore files ``(directory, text)``, those of upper directories first.

    A rule without a slash, but for one at its end, holds at any depth below its file, another one only there; ``!`` takes a path in again,
    ``#`` begins a comment, a backslash makes the next character plain, spaces at the end do not count.
    """
    out = []
    for base, text in sorted(files, key=lambda f: f[0].count("/") if f[0] else -1):
        for line in text.splitlines():
            line = re.sub(r"(?<!\\)[ \t]+$", "", line)
            if not line or line.startswith("#"):
                continue
            takes, line = (False, line[1:]) if line.startswith("!") else (True, line)
            folder, line = line.endswith("/"), line.rstrip("/")
            anywhere, line = "/" not in line, line.lstrip("/")
            if not line:
                continue
            body = ""
            for part in re.findall(r"\\.|/\*\*$|\*\*/|\*\*|\*|\?|\[!?\]?[^\]]*\]|.", line):
                body += {"/**": "/.+", "**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(part) or (("[^" + part[2:] if part[1] == "!" else part) if part[0] == "[" and len(part) > 1 else re.escape(part[-1]))
            top = re.escape(base.strip("/") + "/") if base.strip("/") else ""
            out.append(("^" + top + ("(?:.*/)?" if anywhere else "") + body + "$", takes, folder))
    return out


def ignored(path: Column, rules: Sequence[tuple[str, bool, bool]]) -> Column:
    """Whether a path is ignored: the last rule that matches it or a directory above it decides; what is below an ignored directory stays ignored."""

    def verdict(p: Column, folder: bool) -> Column:
        out = None
        for pattern, takes, only in reversed(list(rules)):
            if folder or not only:
                hit = p.rlike(pattern)
                out = F.when(hit, takes) if out is None else out.when(hit, takes)
        return F.lit(False) if out is None else out.otherwise(False)

    above = F.filter(ancestors(path), lambda d: d != "")
    return F.exists(above, lambda d: verdict(d, True)) | verdict(path, False)


def language_for(path: Column, overrides: Sequence[tuple[str, str]] = ()) -> Column:
    """Language by extension, overridden by globs of which the last that matches wins."""
    ext = extension(path)
    out = None
    for glob, language in reversed(list(overrides)):
        hit = path.rlike(glob_pattern(glob))
        out = F.when(hit, language) if out is None else out.when(hit, language)
    for e, language in LANGUAGE_OF.items():
        out = F.when(ext == e, language) if out is None else out.when(ext == e, language)
    return out.otherwise("c")


def semantic_family(language: Column) -> Column:
    """go or c_family: names of the two never mix."""
    return F.when(language == "go", "go").otherwise("c_family")


def is_marker(path: Column) -> Column:
    """Files that mark the root of a project, without letter case."""
    low = lower_ascii(basename(path))
    return low.isin(list(MARKERS)) | low.rlike("(" + "|".join(re.escape(s) for s in MARKER_SUFFIXES) + ")$")


def ancestors(path: Column) -> Column:
    """All directories at or above a file, the top as an empty string."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.when(n == 0, "").otherwise(F.array_join(F.slice(parts, 1, n), "/")))
