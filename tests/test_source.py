"""The source itself: no name is defined twice, nothing imported is unused, and only the corpus part knows the corpus part."""

import ast
from pathlib import Path

import pytest

ROOT = Path(__file__).parent.parent
FILES = sorted(ROOT.glob("fieldmill/**/*.py"))


@pytest.mark.parametrize("path", FILES, ids=lambda p: str(p.relative_to(ROOT)))
def test_one_definition_of_each_name(path):
    tree = ast.parse(path.read_text())
    for scope in [tree, *[n for n in ast.walk(tree) if isinstance(n, ast.ClassDef)]]:
        names = [n.name for n in scope.body if isinstance(n, (ast.FunctionDef, ast.ClassDef))]
        assert len(names) == len(set(names)), sorted(n for n in names if names.count(n) > 1)


@pytest.mark.parametrize("path", FILES, ids=lambda p: str(p.relative_to(ROOT)))
def test_imports_are_used(path):
    text = path.read_text()
    tree = ast.parse(text)
    marked = {i for i, line in enumerate(text.splitlines(), 1) if "noqa: F401" in line}
    names = {}
    for node in ast.walk(tree):
        if isinstance(node, (ast.Import, ast.ImportFrom)) and node.lineno not in marked and getattr(node, "module", "") != "__future__":
            names |= {(a.asname or a.name.split(".")[0]): node.lineno for a in node.names}
    used = {n.id for n in ast.walk(tree) if isinstance(n, ast.Name)} | {s for n in ast.walk(tree) if isinstance(n, ast.Assign) and any(getattr(t, "id", "") == "__all__" for t in n.targets) for s in ast.literal_eval(n.value)}
    assert not sorted(set(names) - used)


def test_nothing_else_imports_the_corpus_operators():
    for path in FILES:
        if "llm" not in path.parts:
            for node in ast.walk(ast.parse(path.read_text())):
                if isinstance(node, ast.ImportFrom):
                    assert "llm" not in (node.module or "").split(".") and "llm" not in [a.name for a in node.names], path
