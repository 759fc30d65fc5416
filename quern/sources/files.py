"""TOML, configuration, logs, and copies of files; paths of any file system that Spark reads."""

from __future__ import annotations

import os
import tomllib
import urllib.request
from dataclasses import dataclass
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def load_toml(path: str | list[str]) -> dict:
    """A TOML file from a path, ``file://`` or ``http(s)://``; of a list, the shallow union in which later files win."""
    if isinstance(path, list):
        merged: dict = {}
        for p in path:
            merged |= load_toml(p)
        return merged
    if path.startswith("s3://"):
        raise ValueError("s3:// is not read here; copy the file first")
    if path.startswith(("http://", "https://")):
        with urllib.request.urlopen(path) as r:
            return tomllib.loads(r.read().decode())
    return tomllib.loads(Path(path.removeprefix("file://")).read_text())


def dump_toml(value: dict) -> str:
    """Tables of strings, numbers, booleans and tables."""

    def scalar(v) -> str:
        if isinstance(v, bool):
            return str(v).lower()
        if isinstance(v, int | float):
            return repr(v)
        text = str(v).replace("\\", "\\\\").replace('"', '\\"')
        return '"' + "".join(c if c >= " " and c != "\x7f" else f"\\u{ord(c):04x}" for c in text) + '"'

    def key(k: str) -> str:
        return k if k and k.replace("_", "").replace("-", "").isalnum() and k.isascii() else scalar(k)

    lines: list[str] = []

    def table(t: dict, name: str) -> None:
        if name:
            lines.append(f"[{name}]")
        lines.extend(f"{key(k)} = {scalar(v)}" for k, v in t.items() if not isinstance(v, dict))
        for k, v in t.items():
            if isinstance(v, dict):
                table(v, f"{name}.{key(k)}" if name else key(k))

    table(value, "")
    return "\n".join(lines) + "\n"


@dataclass
class Config:
    """Credentials by precedence: argument, environment, file. Each path is read anew, and secrets stay out of Spark's settings."""

    user_id: str
    api_key: str
    path: str

    @classmethod
    def resolve(cls, user_id: str | None = None, api_key: str | None = None, path: str | None = None, environ: dict | None = None) -> Config:
        environ = os.environ if environ is None else environ
        path = path or environ.get("QUERN_CONFIG_PATH") or str(Path.home() / ".quern" / "quernconfig.toml")
        stored = cls.load(path) or {}
        own = stored.get("quern", {})
        user_id = user_id or environ.get("QUERN_USER_ID") or own.get("user_id")
        api_key = api_key or environ.get("QUERN_API_KEY") or own.get("api_key")
        if not user_id or not api_key:
            raise ValueError("user_id and api_key are needed: as arguments, as QUERN_USER_ID and QUERN_API_KEY, or in the configuration file")
        if (own.get("user_id"), own.get("api_key")) != (user_id, api_key):
            cls.write(path, stored | {"quern": own | {"user_id": user_id, "api_key": api_key}})
        return cls(user_id, api_key, path)

    @staticmethod
    def load(path: str) -> dict | None:
        return load_toml(path) if os.path.exists(path) else None

    @staticmethod
    def write(path: str, value: dict) -> None:
        os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
        fd = os.open(path, os.O_WRONLY | os.O_CREAT | os.O_TRUNC, 0o600)
        with os.fdopen(fd, "w") as f:
            f.write(dump_toml(value))


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def upload(spark: SparkSession, source: str, folder: str, name: str | None = None) -> str:
    """Copy a file, the plain files of a directory (not of its subdirectories), or an http(s) resource into ``folder``.
    Returns the name there, by default the last part of ``source``."""
    name = name or source.rstrip("/").rsplit("/", 1)[-1]
    if source.startswith(("http://", "https://")):
        with urllib.request.urlopen(source) as r:
            to, fs = _fs(spark, f"{folder}/{name}")
            out = fs.create(to, True)
            try:
                while chunk := r.read(1 << 20):
                    out.write(bytearray(chunk))
            finally:
                out.close()
        return name
    path, fs = _fs(spark, source)
    to, target = _fs(spark, f"{folder}/{name}")
    util, conf = spark._jvm.org.apache.hadoop.fs.FileUtil, spark._jsc.hadoopConfiguration()
    if not fs.getFileStatus(path).isDirectory():
        util.copy(fs, path, target, to, False, conf)
        return name
    target.mkdirs(to)
    for status in fs.listStatus(path):
        if status.isFile():
            p = status.getPath()
            util.copy(fs, p, target, spark._jvm.org.apache.hadoop.fs.Path(to, p.getName()), False, conf)
    return name


def upload_file(spark: SparkSession, source: str, folder: str, name: str | None = None) -> bool:
    """Whether the copy worked; failures are logged."""
    import logging

    try:
        upload(spark, source, folder, name)
    except Exception as e:  # any file system's error
        logging.getLogger(__name__).error("could not copy %s: %s", source, e)
        return False
    return True


def plain_files(spark: SparkSession, folder: str, prefix: str = ""):
    """(path, length) of the files in a folder whose name starts with ``prefix``; not of subfolders."""
    from pyspark.sql import functions as F

    return spark.read.format("binaryFile").load(folder).where(F.element_at(F.split("path", "/"), -1).startswith(prefix)).select("path", "length")


def log_name(session_id: str) -> str:
    return f"quern-log-for-session-{session_id}"


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a file under another name and give it ``path`` when it is whole."""
    to, fs = _fs(spark, path)
    part = spark._jvm.org.apache.hadoop.fs.Path(to.getParent(), f"_{to.getName()}")
    out = fs.create(part, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    fs.delete(to, False)
    if not fs.rename(part, to):
        raise OSError(f"could not write {path}")


def read_text(spark: SparkSession, path: str) -> str:
    at, fs = _fs(spark, path)
    if not fs.exists(at):
        raise FileNotFoundError(path)
    stream = fs.open(at)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def _session() -> SparkSession:
    return SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()


def download_log(session_id: str, folder: str, to: str | None = None) -> str:
    """Copy a session's log from any file system to this machine; by default to a file of its name in the home directory."""
    to = to or str(Path.home() / log_name(session_id))
    Path(to).write_text(read_text(_session(), f"{folder}/{log_name(session_id)}"))
    return to


def print_log(session_id: str, folder: str, delete: bool = True) -> None:
    """Print a session's log, or a hint if it can't be read; then delete it if asked."""
    spark, path = _session(), f"{folder}/{log_name(session_id)}"
    try:
        print(read_text(spark, path))
    except (OSError, Py4JJavaError) as e:
        print(f"no log of session {session_id} can be read ({e}); it may not have been stored yet")
        return
    if delete:
        at, fs = _fs(spark, path)
        fs.delete(at, False)


def dispatch_tables(base: str, branch: str, packages: list[str]) -> list[str]:
    """Where the dispatch tables of packages are on a branch of a repository of raw files at ``base``."""
    return [f"{base.rstrip('/')}/{branch}/{p}/res/pf_dispatch_table.toml" for p in packages]
