"""What the layout promises."""

from __future__ import annotations

import ast
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def imports(path: Path) -> set[str]:
    found = set()
    for node in ast.walk(ast.parse(path.read_text())):
        if isinstance(node, ast.Import):
            found |= {a.name for a in node.names}
        elif isinstance(node, ast.ImportFrom) and node.module:
            found |= {node.module} | {f"{node.module}.{a.name}" for a in node.names}
    return found


def test_nothing_in_the_library_needs_the_corpus_operators():
    for path in (ROOT / "quillmill").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT / "quillmill").parts:
            assert not any(".llm" in name for name in imports(path)), path


def test_functions_do_not_need_operators_nor_operators_plans():
    for folder, above in (("functions", ("operators", "plans", "sources", "streaming")), ("operators", ("plans", "sources", "streaming"))):
        for path in (ROOT / "quillmill" / folder).rglob("*.py"):
            assert not any(name.startswith(f"quillmill.{a}") for name in imports(path) for a in above), path


def test_no_local_checkpoints_nor_cross_joins_of_tables():
    for path in (ROOT / "quillmill").rglob("*.py"):
        assert "localCheckpoint" not in path.read_text(), path
