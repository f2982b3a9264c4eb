"""Parts of paths and decisions that need only a path."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera import values as V


def name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def directory(path: Column) -> Column:
    """What stands before the last slash; "" for none."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def stem(path: Column) -> Column:
    """The name without its last extension; a leading dot begins no extension."""
    return F.regexp_replace(name(path), r"(?<=.)\.[^.]*$", "")


def root_stem(path: Column) -> Column:
    """What stands before the first dot of the stem."""
    return F.substring_index(stem(path), ".", 1)


def extension(path: Column) -> Column:
    """The last extension in lower case; "" for none."""
    return F.lower(F.regexp_extract(name(path), r".\.([^.]*)$", 1))


def has_extension(path: Column, extensions: list[str]) -> Column:
    return F.coalesce(extension(path).isin([e.lower() for e in extensions]), F.lit(False))


def is_hidden(path: Column) -> Column:
    return F.startswith(name(path), F.lit("."))


def depth(path: Column, root: str) -> Column:
    """Directories between ``root`` and the file; 0 outside root."""
    inside = F.startswith(path, F.lit(root.rstrip("/") + "/"))
    below = F.substr(path, F.lit(len(root.rstrip("/")) + 2))
    return F.when(inside, F.size(F.split(below, "/")) - 1).otherwise(0)


def relative(path: Column, root: str) -> Column:
    """The path below ``root``, else null."""
    prefix = root.rstrip("/") + "/"
    return F.when(F.startswith(path, F.lit(prefix)), F.substr(path, F.lit(len(prefix) + 1)))


def kind(path: Column) -> Column:
    """image, video, sidecar or other."""
    ext = extension(path)
    return (
        F.when(ext.isin(V.IMAGE_EXTENSIONS), "image").when(ext.isin(V.VIDEO_EXTENSIONS), "video")
        .when(ext.isin(V.SIDECAR_EXTENSIONS), "sidecar").otherwise("other")
    )


def shell_kind(path: Column) -> Column:
    """The same by the shorter lists of the launcher script."""
    ext = extension(path)
    return (
        F.when(ext.isin(V.SHELL_IMAGE_EXTENSIONS), "image").when(ext.isin(V.SHELL_VIDEO_EXTENSIONS), "video")
        .when(ext.isin(V.SIDECAR_EXTENSIONS), "sidecar").otherwise("other")
    )


def should_copy(path: Column) -> Column:
    """Files that no converter takes and that aren't hidden are copied as they are."""
    return ~is_hidden(path) & (kind(path) == "other")


def is_potential_media(path: Column) -> Column:
    return (extension(path) != "") & ~extension(path).isin(V.NOT_MEDIA_EXTENSIONS)


def is_uuid_name(text: Column) -> Column:
    return F.rlike(text, F.lit(r"^[0-9A-Fa-f]{8}-([0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}$"))


def format_priority(path: Column) -> Column:
    ext, out = extension(path), F.lit(6)
    for rank, extensions in reversed(V.FORMAT_PRIORITY.items()):
        out = F.when(ext.isin(extensions.split()), rank).otherwise(out)
    return out


def normalised(path: Column) -> Column:
    """Slashes forward and single."""
    return F.regexp_replace(F.regexp_replace(path, r"\\", "/"), "/+", "/")


def converted(path: Column, target: Column | str, suffix: str = "_hevc") -> Column:
    """Where a file is converted to: the stem with the upper-case target extension; with ``suffix`` if only the case differs."""
    target = F.upper(F.lit(target) if isinstance(target, str) else target)
    same = F.upper(extension(path)) == target
    return F.concat(directory(path), F.lit("/"), stem(path), F.when(same, suffix).otherwise(""), F.lit("."), target)


def letters_and_digits(text: Column) -> Column:
    """Lower case without anything else."""
    return F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}]", ""))
