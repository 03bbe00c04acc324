"""Folders and file names of a project's outputs, as expressions over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Folders below the outputs' root (the last three below the project's); {x} is x's value.
FOLDERS = {
    "preprocessing": "preprocessing/{pipeline}/{subject}/ses-{session}/task-{task}/run-{run}",
    "preprocessing_root": "preprocessing/{pipeline}",
    "epochs": "epochs/{preprocessing}/{task}/{subject}/ses-{session}",
    "epochs_root": "epochs/{preprocessing}/{task}",
    "source": "source/{preprocessing}/{task}/{variant}/{subject}/ses-{session}",
    "source_root": "source/{preprocessing}/{task}",
    "features": "features/{preprocessing}/{task}/{variant}/{feature}",
    "features_root": "features/{preprocessing}/{task}",
    "prediction": "prediction/{model}",
    "legacy_outputs": "pipeline-{pipeline}",
    "recordings": "{subject}/ses-{session}/eeg",
    "legacy_pipeline": "pipelines/{pipeline}",
    "configs": "configs/{stage}",
}
#: What these values begin with in a path, whether they were given so or not.
PREFIXES = {"subject": "sub-", "variant": "variant-"}


def prefixed(value: Column, prefix: str) -> Column:
    return F.when(F.startswith(value, F.lit(prefix)), value).otherwise(F.concat(F.lit(prefix), value))


def needed(folder: str) -> list[str]:
    """The values a folder's path is made of."""
    return FOLDERS[folder].replace("}", "{").split("{")[1::2]


def place(folder: str, **values: Column) -> Column:
    """The folder's path; null where a value it needs is null."""
    given = {k: prefixed(v, PREFIXES[k]) if k in PREFIXES else v for k, v in values.items()}
    pieces = FOLDERS[folder].replace("}", "{").split("{")
    return F.concat(*[given[p] if i % 2 else F.lit(p) for i, p in enumerate(pieces) if p])


def file_name(subject: Column, session: Column, task: Column, run: Column | None = None, desc: Column | None = None, suffix: str = "eeg", extension: str = ".fif") -> Column:
    """sub-_ses-_task-[_run-][_desc-]_suffix and extension; a run or description that is null or empty is left out."""
    parts = [prefixed(subject, "sub-"), F.concat(F.lit("ses-"), session), F.concat(F.lit("task-"), task)]
    parts += [F.concat(F.lit(k), F.nullif(v, F.lit(""))) for k, v in (("run-", run), ("desc-", desc)) if v is not None]
    return F.concat(F.concat_ws("_", *parts, F.lit(suffix)), F.lit(extension))
