"""Files that are fetched as a whole, with a note of what was fetched."""

from __future__ import annotations

import hashlib
import json
import os
import shutil
from pathlib import Path
from urllib.request import urlopen

from quillmill.sources.runlog import now

CHUNK = 1 << 20


def fetch_file(url: str, path: str, timeout: float = 120.0) -> dict:
    """Downloads a file and notes its address, digest, size, time and first line in ``_meta.json`` beside it.

    The former note stays as ``_meta.prev.json``. The file takes its place only
    once it is whole, so a broken download changes nothing.
    """
    target, digest, size = Path(path), hashlib.sha256(), 0
    target.parent.mkdir(parents=True, exist_ok=True)
    partial = target.with_name(f"{target.name}.part")
    with urlopen(url, timeout=timeout) as source, partial.open("wb") as out:
        while chunk := source.read(CHUNK):
            out.write(chunk)
            digest.update(chunk)
            size += len(chunk)
    with partial.open(encoding="utf-8-sig", errors="replace", newline="") as lines:
        header = lines.readline().rstrip("\r\n")
    note = target.with_name("_meta.json")
    if note.exists():
        shutil.copyfile(note, target.with_name("_meta.prev.json"))
    os.replace(partial, target)
    meta = {"url": url, "sha256": digest.hexdigest(), "size_bytes": size, "fetched_at": now(), "header_row": header}
    note.write_text(json.dumps(meta, ensure_ascii=False, indent=2), encoding="utf-8")
    return meta
