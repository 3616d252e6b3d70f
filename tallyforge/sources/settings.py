"""Settings files of a project (YAML): models, sources, exposures and folder settings as rows, what is wrong as rows too.

`ProjectSettings` is a Spark data source: it lists the files below a folder and deals them over partitions, which read and
parse them. Where only Spark's readers reach the files, `settings_of` does the same for rows that they have read.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tallyforge.sources.readers import MAX_FILE_BYTES, SKIPPED

#: Settings of a model, and names in a folder that are no folders. Fixed by the format.
SETTINGS = "materialized unique_key incremental_strategy partition_by cluster_by full_refresh on_schema_change".split()
APART = "description meta docs tests columns data_tests".split()
#: Fixed: any of these at the top makes a file one of this kind.
SECTIONS = "models sources exposures seeds snapshots macros tests".split()
PROJECT = "dbt_project.yml"
ENTITY = "path string, entity string, name string, settings map<string,string>, items array<string>, owners array<string>, problem string"
#: Files of a partition.
FILES = 64


def _loaded(text: str):
    try:
        import yaml
    except ImportError as e:
        raise ImportError("settings files need PyYAML") from e
    return yaml.load(text, Loader=getattr(yaml, "CSafeLoader", yaml.SafeLoader))


def _shown(value) -> str | None:
    """A setting as text: lists by commas, a mapping by its field or its values, true and false in lower case."""
    if isinstance(value, dict):
        return _shown(value.get("field")) if "field" in value else ",".join(filter(None, map(_shown, value.values()))) or None
    if isinstance(value, list):
        return ",".join(filter(None, map(_shown, value))) or None
    return None if value is None else str(value).lower() if isinstance(value, bool) else str(value)


def _settings(node) -> dict[str, str]:
    held = {str(k).lstrip("+"): v for k, v in node.items()} if isinstance(node, dict) else {}
    return {k: _shown(held[k]) for k in SETTINGS if _shown(held.get(k)) is not None}


def _listed(value) -> list[str]:
    return [value] if isinstance(value, str) else [str(v) for v in value if isinstance(v, (str, int))] if isinstance(value, list) else []


def _owners(*nodes) -> list[str]:
    """Names of owners: a string, a list, or a mapping with `name` or `email`; of `meta` its `owner` or `owners`."""
    out: list[str] = []
    for node in nodes:
        if isinstance(node, dict):
            node = node.get("owner") or node.get("owners") or node.get("name") or node.get("email")
            node = node.get("name") or node.get("email") if isinstance(node, dict) else node
        out += [o for o in _listed(node) if o not in out]
    return out


def _row(path: str, entity: str, name: str | None = None, settings: dict | None = None, items: list | None = None, owners: list | None = None, problem: str | None = None) -> tuple:
    return path, entity, name, settings or {}, items or [], owners or [], problem


def _folders(path: str, node, folder: str, inherited: dict) -> Iterator[tuple]:
    """A row for each folder, its settings over those it inherits; a stack in place of recursion."""
    todo = [(node, folder, inherited)]
    while todo:
        node, folder, inherited = todo.pop()
        own = inherited | _settings(node)
        yield _row(path, "folder", folder, own)
        for key, value in node.items() if isinstance(node, dict) else ():
            if str(key) not in SETTINGS and str(key) not in APART and not str(key).startswith("+"):
                todo.append((value, f"{folder}/{key}" if folder else str(key), own))


def _project(path: str, found: dict) -> Iterator[tuple]:
    models, name = found.get("models"), found.get("name")
    if not isinstance(models, dict) or not models:
        return
    if name in models or len(models) == 1:
        yield from _folders(path, models[name] if name in models else next(iter(models.values())), "", {})
    else:
        yield _row(path, "reject", problem="ambiguous")


def entities(path: str, text: str | None) -> Iterator[tuple]:
    """The rows of one file; none for YAML of another kind."""
    own = path.replace("\\", "/").lower()
    project = own.rsplit("/", 1)[-1] == PROJECT
    try:
        found = _loaded(text or "")
    except ImportError:
        raise
    except Exception:  # whatever a parser says of a broken file
        yield _row(path, "reject", problem="project" if project else "yaml")
        return
    if not isinstance(found, dict):
        return
    if project:
        yield from _project(path, found)
        return
    if not any(s in found for s in SECTIONS) and "/models/" not in own and not own.startswith("models/"):
        return
    named = lambda section: [n for n in found.get(section) or [] if isinstance(n, dict) and isinstance(n.get("name"), str)] if isinstance(found.get(section), list) else []
    for node in named("models"):
        config = node.get("config") if isinstance(node.get("config"), dict) else {}
        columns = [c["name"] for c in node.get("columns") or [] if isinstance(c, dict) and isinstance(c.get("name"), str)]
        yield _row(path, "model", node["name"], _settings(config), columns, _owners(node.get("meta"), config.get("meta")))
    for node in named("sources"):
        yield _row(path, "source", node["name"], items=[t["name"] for t in node.get("tables") or [] if isinstance(t, dict) and isinstance(t.get("name"), str)])
    for node in named("exposures"):
        yield _row(path, "exposure", node["name"], items=_listed(node.get("depends_on")), owners=_owners(node.get("owner"), node.get("meta")))


class _Files(InputPartition):
    def __init__(self, files: list[tuple[str, int]]) -> None:
        self.files = files


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.root, self.most = options["path"], int(options.get("maxbytes", MAX_FILE_BYTES))

    def _store(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.root) if "://" in self.root else (fs.LocalFileSystem(), os.path.abspath(self.root))

    def partitions(self) -> list[_Files]:
        """Settings files below the root, outside skipped folders; only their names and sizes are looked at here."""
        from pyarrow import fs

        store, root = self._store()
        found, todo = [], [root]
        while todo:
            for x in store.get_file_info(fs.FileSelector(todo.pop())):
                if x.type == fs.FileType.Directory and x.base_name not in SKIPPED:
                    todo.append(x.path)
                elif x.type == fs.FileType.File and x.extension.lower() in ("yml", "yaml"):
                    found.append((x.path, x.size))
        found.sort()
        return [_Files(found[i : i + FILES]) for i in range(0, len(found), FILES)] or [_Files([])]

    def read(self, partition: _Files) -> Iterator[tuple]:
        store, root = self._store()
        for path, size in partition.files:
            shown = path[len(root) :].lstrip("/")
            if size > self.most:
                yield _row(shown, "reject", problem="oversize")
                continue
            try:
                with store.open_input_stream(path) as f:
                    text = f.read().decode("utf-8")
            except (OSError, UnicodeDecodeError):
                yield _row(shown, "reject", problem="unreadable")
                continue
            yield from entities(shown, text)


class ProjectSettings(DataSource):
    """Format `project_settings`; options: path, and maxBytes of a file."""

    @classmethod
    def name(cls) -> str:
        return "project_settings"

    def schema(self) -> str:
        return ENTITY

    def reader(self, schema) -> _Reader:
        return _Reader({k.lower(): v for k, v in self.options.items()})


def project_settings(spark: SparkSession, root: str, most: int = MAX_FILE_BYTES) -> DataFrame:
    """The rows (ENTITY) of all settings files below root, by paths relative to it."""
    spark.dataSource.register(ProjectSettings)
    return spark.read.format("project_settings").option("maxBytes", most).load(root)


def settings_of(files: DataFrame) -> DataFrame:
    """The rows (ENTITY) of files (path, text) that Spark has read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("path", pa.string()), ("entity", pa.string()), ("name", pa.string()), ("settings", pa.map_(pa.string(), pa.string())), ("items", pa.list_(pa.string())), ("owners", pa.list_(pa.string())), ("problem", pa.string())])
        for batch in batches:
            rows = [r for p, t in zip(*[c.to_pylist() for c in batch.columns], strict=True) for r in entities(p, t)]
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in kind]
            yield pa.RecordBatch.from_arrays([pa.array([list(v.items()) for v in c] if f.name == "settings" else list(c), f.type) for c, f in zip(columns, kind, strict=True)], schema=kind)

    return files.select("path", "text").mapInArrow(run, ENTITY)


def folder_settings(found: DataFrame) -> DataFrame:
    """(project, folder, settings): of each project file its folders with all that they inherit."""
    return found.where("entity = 'folder'").select(F.regexp_replace("path", "(^|/)[^/]*$", "").alias("project"), F.col("name").alias("folder"), "settings")


def settings_findings(found: DataFrame) -> DataFrame:
    """(path, rule, severity) of what could not be read: a schema file, a project file or its models block, a skipped file."""
    rule = F.when(F.col("problem") == "yaml", "R024").when(F.col("problem").isin("project", "ambiguous"), "R025").otherwise("R026")
    return found.where("entity = 'reject'").select("path", rule.alias("rule"), F.lit("low").alias("severity"))
