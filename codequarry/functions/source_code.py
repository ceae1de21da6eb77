"""Functions found in Python source text, as a table function.

The standard library's own parser does the reading; Spark spreads the files,
explodes the result and does all that follows. One call yields both the record
of a function and its docstring split, so source text goes to Python once.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

from pyspark.sql import functions as F

FUNCTION_SCHEMA = (
    "name string, args array<string>, args_types array<string>, "
    "args_defaults array<string>, body string, docstring string, lineno int, error string"
)


def _definitions(tree: ast.AST) -> Iterator[ast.FunctionDef]:
    """Plain ``def`` nodes, outer before inner, in source order."""
    pending = [tree]
    while pending:
        node = pending.pop()
        if isinstance(node, ast.FunctionDef):
            yield node
        pending.extend(reversed(list(ast.iter_child_nodes(node))))


def _is_text(statement: ast.stmt) -> bool:
    return (
        isinstance(statement, ast.Expr)
        and isinstance(statement.value, ast.Constant)
        and isinstance(statement.value.value, str)
    )


def split_docstring(statements: list[ast.stmt]) -> tuple[str, str | None]:
    """(body without docstring, docstring); an empty docstring counts as none."""
    docstring = ast.get_docstring(ast.Module(statements, [])) if statements else None
    if docstring:
        return ast.unparse(ast.Module(statements[1:], [])), docstring.replace("\0", "")
    return ast.unparse(statements).strip(), None


def split_body_text(body: str) -> tuple[str, str | None]:
    """The same split for body text that is not parsed yet.

    Text with no docstring may open with a comment line, which then serves as
    one. Text that does not parse comes back unchanged.
    """
    try:
        statements = ast.parse(body).body
        if statements and _is_text(statements[0]):
            rest, docstring = split_docstring(statements)
            if docstring:
                return rest.replace("\0", ""), docstring
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return body, None
    first, *rest_lines = body.splitlines() or [""]
    comment = first.strip()
    if not comment.startswith("#"):
        return "\n".join([first, *rest_lines]).strip().replace("\0", ""), None
    words = comment.lstrip("#").strip().replace("\0", "")
    return "\n".join(rest_lines).strip().replace("\0", ""), words or None


def function_rows(content: str | None) -> Iterator[tuple]:
    """One row per function, or a single reject row carrying the error."""
    if content is None:
        return
    rows = []
    try:
        for node in _definitions(ast.parse(content.replace("\0", ""))):
            named = node.args.args
            body, docstring = split_docstring(node.body)
            rows.append(
                (
                    node.name,
                    [arg.arg for arg in named],
                    [ast.unparse(arg.annotation) for arg in named if arg.annotation],
                    [ast.unparse(value) for value in node.args.defaults],
                    body.replace("\0", ""),
                    docstring,
                    node.lineno,
                    None,
                )
            )
    except Exception as problem:  # any bad file is a reject, never a failed job
        yield (None, None, None, None, None, None, None, type(problem).__name__)
        return
    yield from rows


@F.udtf(returnType=FUNCTION_SCHEMA, useArrow=True)
class FunctionsIn:
    """``LATERAL`` table function: source text to its functions."""

    def eval(self, content: str) -> Iterator[tuple]:
        yield from function_rows(content)


@F.udtf(returnType="body string, docstring string", useArrow=True)
class BodySplit:
    """``LATERAL`` table function: body text to (body, docstring)."""

    def eval(self, body: str) -> Iterator[tuple]:
        if body is not None:
            yield split_body_text(body)
