"""Column expressions: identifiers, paths, names, numbers and times."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def stable_id(value: Column, length: int = 16) -> Column:
    return F.substring(F.sha1(value), 1, length)


def stable_int(value: Column, modulo: int = 10_000_000) -> Column:
    """The 160-bit digest reduced modulo ``modulo``, digit by digit to stay inside BIGINT."""
    digits = F.transform(
        F.split(F.sha1(value), ""), lambda d: F.conv(F.when(d == "", "0").otherwise(d), 16, 10).cast("bigint")
    )
    return F.aggregate(digits, F.lit(0).cast("bigint"), lambda acc, d: (acc * 16 + d) % modulo)


def posix(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def basename(path: Column) -> Column:
    return F.element_at(F.split(posix(path), "/"), -1)


def parent_path(path: Column) -> Column:
    return F.regexp_replace(posix(path), "/[^/]*$", "")


def parent_name(path: Column) -> Column:
    return F.coalesce(F.try_element_at(F.split(posix(path), "/"), F.lit(-2)), F.lit(""))


def suffix(path: Column) -> Column:
    """Final extension with its dot; a leading dot alone does not start one."""
    return F.lower(F.regexp_extract(basename(path), "^.+(\\.[^.]+)$", 1))


def stem(path: Column) -> Column:
    name = basename(path)
    return F.regexp_replace(name, "(?<=.)\\.[^.]+$", "")


def clean_name(text: Column) -> Column:
    """Lower-case name with runs of unusual characters turned into one underscore."""
    return F.lower(F.trim(F.regexp_replace(text, "[^A-Za-z0-9_.-]+", "_"), F.lit("_")))


def clean_part(text: Column) -> Column:
    """Path part: every unusual character becomes an underscore, case kept, ``unknown`` if empty."""
    part = F.regexp_replace(F.trim(text), r"[^\p{L}\p{N}_.-]", "_")
    return F.coalesce(F.nullif(part, F.lit("")), F.lit("unknown"))


def error_text(message: Column, limit: int = 5000) -> Column:
    return F.left(F.coalesce(message, F.lit("Unknown error")), F.lit(limit))


def remote_uri(remote: Column, path: Column) -> Column:
    return F.concat(F.lit("gdrive://"), remote, F.lit("/"), F.ltrim(path, F.lit("/")))


def augmentation_id(stage: Column, repeat: Column, fold: Column, cls: Column, ordinal: Column, hashed: Column) -> Column:
    return F.concat(
        F.lit("S"), stage.cast("string"), F.lit("_R"), repeat.cast("string"), F.lit("_F"), fold.cast("string"),
        F.lit("_"), cls, F.lit("_"), padded(ordinal, 5), F.lit("_"), hashed,
    )


def padded(number: Column, width: int) -> Column:
    """Zero-padded integer that keeps every digit of longer numbers, unlike ``lpad``."""
    text = number.cast("string")
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def stage_folder(stage: Column) -> Column:
    return F.concat(F.lit("stage_"), padded(stage, 2))


def trial_folder(trial: Column) -> Column:
    return F.coalesce(F.concat(F.lit("trial_"), padded(trial, 6)), F.lit("non_hpo"))


def checkpoint_file_name(kind: Column, epoch: Column) -> Column:
    """Name by checkpoint type; an unknown type or a missing epoch is an error."""
    kind = F.upper(F.trim(kind))
    return (
        F.when(
            kind.isin("INTERVAL", "EPOCH"),
            F.when(epoch.isNotNull(), F.concat(F.lit("epoch_"), padded(epoch, 4), F.lit(".pt"))).otherwise(
                F.raise_error(F.lit("epoch is required for an interval checkpoint")).cast("string")
            ),
        )
        .when(kind == "BEST", F.lit("best.pt"))
        .when(kind == "FINAL", F.lit("final.pt"))
        .when(kind == "RECOVERY", F.lit("recovery.pt"))
        .otherwise(F.raise_error(F.concat(F.lit("unknown checkpoint type "), kind)).cast("string"))
    )


def split_ops(text: Column) -> Column:
    return F.filter(F.split(text, "\\+"), lambda part: F.trim(part) != "")


def epoch_seed(base, repeat, fold, epoch) -> Column:
    return base + repeat * 1000 + fold * 100 + epoch


def health(age_seconds: Column, stale: int = 120, offline: int = 300) -> Column:
    return F.when(age_seconds > offline, "OFFLINE").when(age_seconds > stale, "STALE").otherwise("OK")


def finite(value: Column) -> Column:
    """Infinite and NaN values become null."""
    number = value.cast("double")
    return F.when(F.isnan(number) | (F.abs(number) == float("inf")), F.lit(None)).otherwise(number)


def hashed_index(text: Column, size: Column) -> Column:
    """Pseudo-random index in ``[0, size)`` from the first 32 bits of an md5."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") % size
