"""Skills on disk: SKILL.md with six fields, and scripts that hold fix(df, columns) and its test."""

from __future__ import annotations

import ast
import json
import re
import zipfile
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame

# The format.
FIELDS = ("name", "description", "license", "compatibility", "metadata", "allowed-tools")
NAME = re.compile(r"[a-z0-9-]{1,64}")
MAX_DESCRIPTION, MAX_BODY_LINES = 1024, 500


@dataclass
class Skill:
    name: str
    description: str
    fix_source: str
    test_source: str = ""
    metadata: dict[str, str] = field(default_factory=dict)
    license: str = "MIT"
    compatibility: str = ">=0.1.0"
    allowed_tools: list[str] = field(default_factory=list)
    body: str = ""


def quote(value: str) -> str:
    return '"' + value.replace("\\", "\\\\").replace('"', '\\"') + '"'


def unquote(value: str) -> str:
    if len(value) >= 2 and value[0] == value[-1] == '"':
        return re.sub(r"\\(.)", r"\1", value[1:-1])
    return value


def render(s: Skill) -> str:
    meta = "".join(f"  {k}: {quote(str(v))}\n" for k, v in s.metadata.items())
    return f"---\nname: {s.name}\ndescription: {quote(s.description)}\nlicense: {quote(s.license)}\ncompatibility: {quote(s.compatibility)}\nmetadata:\n{meta}allowed-tools: [{', '.join(s.allowed_tools)}]\n---\n{s.body}"


def parse(text: str) -> tuple[dict, str]:
    """Front matter and body; anything but plain fields, one level of metadata and flat lists is an error."""
    hit = re.fullmatch(r"---\n(.*?)\n---\n?(.*)", text, re.S)
    if not hit:
        raise ValueError("SKILL.md must start with front matter between --- lines")
    front: dict = {}
    inner: dict | None = None
    for line in hit[1].splitlines():
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        key, colon, value = (x.strip() for x in line.partition(":"))
        nested = line.startswith("  ")
        if not colon or nested and (inner is None or not value):
            raise ValueError(f"not in the supported subset: {line!r}")
        if nested:
            inner[key] = unquote(value)
        elif not value:
            inner = front[key] = {}
        else:
            inner = None
            front[key] = [unquote(x.strip()) for x in value[1:-1].split(",") if x.strip()] if value[0] == "[" else unquote(value)
    return front, hit[2]


def problems(s: Skill, folder: str) -> list[str]:
    """Everything that speaks against a skill."""
    out = []
    if not NAME.fullmatch(s.name):
        out.append(f"name {s.name!r} must be 1 to 64 of a-z, 0-9 and -")
    if s.name != folder:
        out.append(f"name {s.name!r} must be that of its folder, {folder!r}")
    if not 1 <= len(s.description) <= MAX_DESCRIPTION:
        out.append(f"the description must have 1 to {MAX_DESCRIPTION} characters")
    if any(not isinstance(k, str) or not isinstance(v, str) for k, v in s.metadata.items()):
        out.append("metadata must map strings to strings")
    if s.body.count("\n") >= MAX_BODY_LINES:
        out.append(f"the body must have fewer than {MAX_BODY_LINES} lines")
    try:
        functions = {n.name: [a.arg for a in n.args.args] for n in ast.parse(s.fix_source).body if isinstance(n, ast.FunctionDef)}
        if functions.get("fix") != ["df", "columns"]:
            out.append("scripts/fix.py must define fix(df, columns) at its top level")
    except SyntaxError as e:
        out.append(f"scripts/fix.py has a syntax error: {e.msg} (line {e.lineno})")
    return out


def save(s: Skill, root: str | Path) -> Path:
    if bad := problems(s, s.name):
        raise ValueError(f"{s.name!r} is not written: {'; '.join(bad)}")
    path = Path(root) / s.name
    (path / "scripts").mkdir(parents=True, exist_ok=True)
    for name, text in (("SKILL.md", render(s)), ("scripts/fix.py", s.fix_source), ("scripts/test_fix.py", s.test_source)):
        (path / name).write_text(text, "utf-8")
    return path


def load(path: str | Path) -> Skill:
    path = Path(path)
    front, body = parse((path / "SKILL.md").read_text("utf-8"))
    if extra := sorted(set(front) - set(FIELDS)):
        raise ValueError(f"{path.name}/SKILL.md has fields beyond the six: {', '.join(extra)}")
    read = lambda name: (path / "scripts" / name).read_text("utf-8")
    s = Skill(front.get("name", ""), front.get("description", ""), read("fix.py"), read("test_fix.py"), front.get("metadata", {}), front.get("license", "MIT"), front.get("compatibility", ""), front.get("allowed-tools", []), body)
    if bad := problems(s, path.name):
        raise ValueError(f"{path.name} is no valid skill: {'; '.join(bad)}")
    return s


def function(source: str) -> Callable[[DataFrame, list[str]], DataFrame]:
    """The fix function of a source that passes the screen; its code never runs otherwise."""
    from ..operators.verify import screen

    if bad := screen(source):
        raise ValueError(f"the code is refused: {', '.join(bad)}")
    space: dict = {}
    exec(compile(source, "<skill>", "exec"), space)  # noqa: S102
    return space["fix"]


def run_tests(s: Skill) -> list[str]:
    """Runs the skill's test_ functions with fix in reach; the names of those that fail, with why."""
    from ..operators.verify import screen

    if bad := screen(s.test_source):
        return [f"refused: {', '.join(bad)}"]
    space: dict = {"fix": function(s.fix_source)}
    exec(compile(s.test_source, "<test>", "exec"), space)  # noqa: S102
    failed = []
    for name, f in list(space.items()):
        if name.startswith("test_") and callable(f):
            try:
                f()
            except Exception as e:  # noqa: BLE001
                failed.append(f"{name}: {type(e).__name__}: {e}")
    return failed


def parse_proposal(text: str) -> dict | None:
    """A skill proposed in a model's reply, as tagged parts; None unless all are there."""
    parts = {tag: re.search(rf"<{tag}>(.*?)</{tag}>", text, re.S) for tag in ("name", "description", "fix", "test")}
    return {k: m[1].strip() for k, m in parts.items()} if all(parts.values()) else None


def export(root: str | Path, entries: dict, target: str | Path, states: tuple[str, ...] = ("proven",)) -> Path:
    """A zip of the skills in some states with a manifest; absolute paths are scrubbed."""
    target, manifest = Path(target), []
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for name, e in sorted(entries.items()):
            if e["state"] not in states or not (Path(root) / name).is_dir():
                continue
            for f in sorted((Path(root) / name).rglob("*")):
                if f.is_file():
                    z.writestr(f"{name}/{f.relative_to(Path(root) / name)}", re.sub(r"(?<![\w/])/(?:[\w.-]+/)+[\w.-]+", "<path>", f.read_text("utf-8")))
            manifest.append({k: e[k] for k in ("name", "disease", "state", "successes", "failures")})
        z.writestr("manifest.json", json.dumps(manifest, indent=2))
    return target
