import ast
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_nothing_in_the_library_imports_the_text_subpackage():
    for f in (ROOT / "tallyforge").rglob("*.py"):
        if "llm" in f.relative_to(ROOT).parts:
            continue
        for node in ast.walk(ast.parse(f.read_text())):
            names = [node.module or ""] if isinstance(node, ast.ImportFrom) else [a.name for a in node.names] if isinstance(node, ast.Import) else []
            assert not any(n.startswith("tallyforge.llm") for n in names), f
