"""Admission of check functions that users or a language model wrote, before they run on samples.

One visit of the syntax tree gathers all that speaks against a check. What has no such fault is called once, in a process of its
own that has a deadline: a check that never ends costs its row a reason, and not the task.
"""

from __future__ import annotations

import ast
import json
import subprocess
import sys
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# What a check may not hold, its one argument, the parts of the sample that it is tried on, the results that it
# may give, and the words of the reasons.
BANNED_STATEMENTS = ["Import", "ImportFrom", "With", "AsyncFunctionDef", "ClassDef", "Global", "Nonlocal"]
BANNED_CALLS = ["eval", "exec", "open", "compile", "__import__"]
ARGUMENTS = ["sample"]
SAMPLE = ["question", "prediction", "answer", "context"]
RESULTS = ["pass", "fail", "inconclusive"]
REASONS = {"count": "must_contain_exactly_one_function", "name": "function_name_mismatch", "arguments": "invalid_signature_args", "statement": "banned_node", "call": "banned_call", "syntax": "syntax_error", "raises": "runtime_error", "shape": "probe_not_dict", "result": "probe_bad_result", "late": "probe_timeout"}
#: Graver ones first; what is banned goes by its place in the tree.
GRAVITY = ["count", "name", "arguments", "banned"]


class _Inspector(ast.NodeVisitor):
    """Collects faults as (gravity, depth, line, text) while it goes through a tree once."""

    def __init__(self, name: str):
        self.name, self.faults, self.depth = name, [], 0

    def blame(self, gravity: str, node: ast.AST, text: str) -> None:
        self.faults.append((GRAVITY.index(gravity), self.depth, getattr(node, "lineno", 0), text))

    def visit_Module(self, module: ast.Module) -> None:
        top = {type(x): x for x in module.body if isinstance(x, ast.FunctionDef)}
        if sum(isinstance(x, ast.FunctionDef) for x in module.body) == 1:
            self.signature(top[ast.FunctionDef])
        else:
            self.blame("count", module, REASONS["count"])
        self.below(module)

    def signature(self, function: ast.FunctionDef) -> None:
        taken = [a.arg for a in function.args.args]
        if function.name != self.name:
            self.blame("name", function, f"{REASONS['name']}: {function.name}")
        if taken != ARGUMENTS:
            self.blame("arguments", function, f"{REASONS['arguments']}: {taken}")

    def visit_Call(self, call: ast.Call) -> None:
        if getattr(call.func, "id", None) in BANNED_CALLS:
            self.blame("banned", call, f"{REASONS['call']}: {call.func.id}")
        self.below(call)

    def generic_visit(self, node: ast.AST) -> None:
        kind = type(node).__name__
        if kind in BANNED_STATEMENTS:
            self.blame("banned", node, f"{REASONS['statement']}: {kind}")
        self.below(node)

    def below(self, node: ast.AST) -> None:
        self.depth += 1
        super().generic_visit(node)
        self.depth -= 1


def faults(name: str | None, code: str | None) -> list[tuple[int, str]]:
    """(line, reason) of all faults of a check's form, the gravest first; null code is empty, and so holds no function."""
    try:
        tree = ast.parse(code or "")
    except (SyntaxError, ValueError, RecursionError, MemoryError) as fault:
        return [(getattr(fault, "lineno", None) or 0, f"{REASONS['syntax']}: {fault}")]
    inspector = _Inspector(name or "")
    inspector.visit(tree)
    found = sorted(inspector.faults, key=lambda f: f[:2])
    alone = [f for f in found if f[0] == GRAVITY.index("count")]
    return [(line, text) for _, _, line, text in alone or found]


#: Run in a process of its own: reads name and code as JSON, writes what a call on an empty sample gives.
_TRIAL = """
import json, re, sys
name, code, keys = json.load(sys.stdin)
say = lambda kind, text: print("\\x00" + json.dumps([kind, text]), flush=True)
names = {"re": re}
try:
    exec(compile(code, "<check>", "exec"), names)
    given = names[name](dict.fromkeys(keys, ""))
except BaseException as fault:
    say("raises", str(fault))
else:
    say("gives", str(given.get("result"))) if isinstance(given, dict) else say("shape", "")
"""


def trial(name: str, code: str, seconds: float = 5.0) -> str:
    """ok, or what a call of a check on an empty sample shows within ``seconds``."""
    try:
        ran = subprocess.run([sys.executable, "-I", "-c", _TRIAL], input=json.dumps([name, code, SAMPLE]), capture_output=True, text=True, timeout=seconds, check=False)
    except subprocess.TimeoutExpired:
        return REASONS["late"]
    kind, text = json.loads(ran.stdout.rpartition("\0")[2] or '["raises", "the process died"]')
    if kind == "gives":
        return "ok" if text in RESULTS else REASONS["result"]
    return f"{REASONS[kind]}: {text}" if kind == "raises" else REASONS[kind]


def verdict(name: str | None, code: str | None, seconds: float = 5.0) -> str:
    """ok, or the first reason against a check."""
    against = faults(name, code)
    return against[0][1] if against else trial(name or "", code or "", seconds)


def _unfenced(code: str) -> list[str]:
    """The lines between the fences around a code, if it has such."""
    lines = code.strip().splitlines()
    if lines and lines[0].startswith("```"):
        lines[0] = lines[0][3:].lstrip("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
    if lines and lines[-1].endswith("```"):
        lines[-1] = lines[-1][:-3]
    return lines


def tidy(name: str | None, code: str | None) -> str:
    """A code without fences, plain imports of one name on lines of their own, and trailing blanks, and with ``name`` for its first
    function; what does not parse is only freed of fences and blanks. Null code is empty, a null name renames nothing."""
    lines = _unfenced(code or "")
    try:
        tree = ast.parse("\n".join(lines))
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        tree = ast.Module([], [])
    nodes = list(ast.walk(tree))
    functions = [n for n in nodes if isinstance(n, ast.FunctionDef)]
    if functions and name is not None:
        first = min(functions, key=lambda f: (f.lineno, f.col_offset))
        line = lines[first.lineno - 1].encode()
        head, tail = line[: first.col_offset], line[first.col_offset + len("def") :].lstrip()
        lines[first.lineno - 1] = head.decode() + f"def {name}" + tail[len(first.name.encode()) :].lstrip().decode()
    for node in nodes:
        if isinstance(node, (ast.Import, ast.ImportFrom)) and len(node.names) == 1 and not node.names[0].asname:
            own = lines[node.lineno - 1]
            if node.lineno == node.end_lineno and own.strip() == ast.unparse(node):
                lines[node.lineno - 1] = ""
    return "\n".join(x.rstrip() for x in lines).strip()


def tidied(df: DataFrame, name_col: str = "name", code_col: str = "code") -> DataFrame:
    """``df`` with its codes as :func:`tidy` leaves them; all other columns pass through."""

    @F.pandas_udf(StringType())
    def run(names: pd.Series, codes: pd.Series) -> pd.Series:
        return pd.Series([tidy(n, c) for n, c in zip(names, codes, strict=True)], dtype=object)

    return df.withColumn(code_col, run(F.col(name_col).cast("string"), F.col(code_col).cast("string")))


def admitted(df: DataFrame, name_col: str = "name", code_col: str = "code", seconds: float = 5.0) -> DataFrame:
    """``df`` with reason (ok, or the first fault of the code) and admitted (reason is ok).

    The form is judged by the syntax tree; what passes is called once on an empty sample, within ``seconds``. The process that
    calls it is no sandbox: run code of authors you trust. Rows are judged alone: repeated ones alike, an empty table
    gives an empty result, columns named reason or admitted are replaced and all others pass through.
    """
    own = df.select(F.struct(*[c for c in df.columns if c not in ("reason", "admitted")]).alias("__own"), F.col(name_col).alias("__name"), F.col(code_col).alias("__code"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = [verdict(n, c, seconds) for n, c in zip(batch.column("__name").to_pylist(), batch.column("__code").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("__own"), pa.array(said, pa.string())], ["__own", "reason"])

    out = own.mapInArrow(judge, f"__own {own.schema['__own'].dataType.simpleString()}, reason string")
    return out.select("__own.*", "reason", (F.col("reason") == "ok").alias("admitted"))
