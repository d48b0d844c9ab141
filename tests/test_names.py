"""Every module-level name that a function of the package reads is there, so that no query ends with a NameError."""

import builtins
import dis
import importlib
import pkgutil
from types import CodeType

import glosswork


def read_by(code: CodeType) -> set[str]:
    own = {i.argval for i in dis.get_instructions(code) if i.opname == "LOAD_GLOBAL"}
    return own.union(*(read_by(c) for c in code.co_consts if isinstance(c, CodeType)))


def test_global_names_exist():
    lacking = []
    for found in pkgutil.walk_packages(glosswork.__path__, "glosswork."):
        module = importlib.import_module(found.name)
        code = compile(module.__loader__.get_source(found.name), found.name, "exec")
        lacking += [(found.name, n) for n in sorted(read_by(code)) if not hasattr(module, n) and not hasattr(builtins, n)]
    assert lacking == []
