"""Portable bundles: tables and state in one archive whose members are checked by hash."""

from __future__ import annotations

import hashlib
import io
import json
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most members, bytes in all, bytes of the manifest and of the state.
MEMBERS, TOTAL, MANIFEST, STATE = 200_000, 8 << 30, 4 << 20, 32 << 20


def safe_name(name: str) -> bool:
    parts = name.replace("\\", "/").split("/")
    return bool(name) and not name.startswith(("/", "\\")) and ".." not in parts and ":" not in parts[0] and "\x00" not in name


def export_bundle(tables: dict[str, DataFrame], target: str, state: dict | None = None) -> dict:
    """Write tables (as Parquet files) and state to one ZIP file; returns the manifest.  For tables of a workspace, not of a cluster."""
    work = Path(tempfile.mkdtemp(prefix="bundle-"))
    try:
        manifest: dict = {"format": 1, "tables": {}, "members": {}}
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED, allowZip64=True) as z:

            def put(name: str, data: bytes):
                manifest["members"][name] = {"sha256": hashlib.sha256(data).hexdigest(), "bytes": len(data)}
                z.writestr(name, data)

            for name, df in tables.items():
                df.write.parquet(str(work / name))
                files = sorted((work / name).glob("*.parquet"))
                manifest["tables"][name] = [f"tables/{name}/{i:05d}.parquet" for i in range(len(files))]
                for member, path in zip(manifest["tables"][name], files):
                    put(member, path.read_bytes())
            put("state.json", json.dumps(state or {}).encode())
            z.writestr("manifest.json", json.dumps(manifest))
        return manifest
    finally:
        shutil.rmtree(work, ignore_errors=True)


def inspect_bundle(path: str) -> dict:
    """The manifest of a bundle whose names, sizes and hashes are all right; ValueError otherwise."""
    try:
        z = zipfile.ZipFile(path)
    except (zipfile.BadZipFile, OSError) as e:
        raise ValueError(f"not a bundle: {e}") from e
    with z:
        infos = {i.filename: i for i in z.infolist()}
        if len(infos) > MEMBERS or sum(i.file_size for i in infos.values()) > TOTAL:
            raise ValueError("the bundle is too large")
        if not all(map(safe_name, infos)):
            raise ValueError("the bundle has an unsafe name")
        if "manifest.json" not in infos or infos["manifest.json"].file_size > MANIFEST:
            raise ValueError("the bundle has no usable manifest")
        try:
            manifest = json.loads(z.read("manifest.json"))
            members = manifest["members"]
        except (ValueError, KeyError, TypeError) as e:
            raise ValueError("the manifest is damaged") from e
        if set(infos) - {"manifest.json"} != set(members):
            raise ValueError("members and manifest differ")
        for name, m in members.items():
            if infos[name].file_size != m["bytes"] or (name == "state.json" and m["bytes"] > STATE):
                raise ValueError(f"{name} has another size")
            h = hashlib.sha256()
            with z.open(name) as f:
                while chunk := f.read(1 << 20):
                    h.update(chunk)
            if h.hexdigest() != m["sha256"]:
                raise ValueError(f"{name} was changed")
        return manifest


def restore_bundle(spark: SparkSession, path: str, into: str, pins_of: str = "pins") -> tuple[dict[str, DataFrame], dict, list]:
    """(tables, state, dropped pins) of a checked bundle, unpacked to a new folder.  A failure leaves no folder behind.

    Pins are card ids in the state; those that no card has are dropped and reported.
    """
    manifest = inspect_bundle(path)
    target = Path(into)
    if target.exists():
        raise ValueError(f"{into} exists")
    try:
        with zipfile.ZipFile(path) as z:
            for names in manifest["tables"].values():
                for name in names:
                    (target / name).parent.mkdir(parents=True, exist_ok=True)
                    (target / name).write_bytes(z.read(name))
            state = json.loads(z.read("state.json"))
        tables = {t: spark.read.parquet(str(target / "tables" / t)) for t, names in manifest["tables"].items() if names}
        pins = state.get(pins_of) or []
        dropped = []
        if pins and "cards" in tables:
            asked = spark.createDataFrame([(p,) for p in pins], "card_id string")
            held = {r.card_id for r in asked.join(tables["cards"].select("card_id"), "card_id", "left_semi").collect()}
            dropped = [p for p in pins if p not in held]
            state[pins_of] = [p for p in pins if p in held]
        return tables, state, dropped
    except Exception:
        shutil.rmtree(target, ignore_errors=True)
        raise


def missing_sources(cards: DataFrame, sources: DataFrame) -> DataFrame:
    """Source ids that cards name and no source row has."""
    return cards.where(F.col("source_id").isNotNull()).select("source_id").distinct().join(sources.select("source_id"), "source_id", "left_anti")


def read_member(path: str, name: str) -> bytes:
    with zipfile.ZipFile(io.BytesIO(Path(path).read_bytes())) as z:
        return z.read(name)
