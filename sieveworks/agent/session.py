"""A session: tables by name, gated questions and cleanings, all logged.

A model is any callable from messages to text; none is needed for cleaning with built-in repairs and
skills. Code that a model writes is run only if the session allows code, after the screen and the
person's decision. ``decide`` is called with a Gate and answers "run", "skip" or ("reject", note).
"""

from __future__ import annotations

import contextlib
import hashlib
import io
import json
import re
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..findings import AUTO, Finding
from ..operators.detect import detect_all
from ..operators.family import harmonize, slice_variable
from ..operators.repair import FIXES, ORDER
from ..operators.row_checks import detect_family
from ..operators.verify import admissible, frozen_case, preview, screen, verify
from ..profile import profile_df
from ..sources.readers import read, read_family, session as spark_session
from . import provenance, skills
from .cards import AnswerCard, CleanReport, passed_checks
from .library import Library, unattended
from .transcript import Transcript

# Budgets.
MAX_CELLS, CLIP, COMPACT_CHARS, KEEP_MESSAGES, SKILL_TRIES, MODEL_TRIES = 6, 2000, 60_000, 8, 3, 3

SYSTEM = """You analyse data with PySpark. Answer with exactly one of
<execute>one Python cell</execute> or <answer>the answer in plain words with its key numbers</answer>.
Tables are DataFrame variables and temp views of the same name; spark and F (pyspark.sql.functions) are in reach.
Each cell is reviewed before it runs; you have 6 cells for a question. Never show a whole table.
Before you answer, your last cell must set a variable named result and end with one to three assert
statements that would fail if it were wrong; they become the checks of the answer."""
NUDGE = "Answer with exactly one <execute>...</execute> or one <answer>...</answer>."
CHECKS = "Your last cell has no assert. Run one more cell that checks the result, then answer."
FORCED = "The cells are used up. Answer now with <answer>...</answer>, and say what could not be verified."
INTENT = "Restate what the code computed and compare it with the question. Use <restatement>, <verdict>match or mismatch</verdict> and <reason>."
FIX = "Write one Python function fix(df, columns) in <execute>...</execute> that repairs the finding on a PySpark DataFrame and changes nothing else."


@dataclass(frozen=True)
class Gate:
    """Something that waits for a person's decision."""

    code: str
    title: str = ""
    preview: str = ""
    grade: str = ""


def by_policy(policy: str) -> Callable[[Gate], str]:
    """Decisions given beforehand: "all" runs everything, else only what needs no judgement runs."""
    return lambda g: "run" if policy == "all" or g.grade == AUTO else "skip"


def parse_tags(text: str) -> tuple[str, str]:
    cells, answers = (re.findall(rf"<{t}>(.*?)</{t}>", text, re.S) for t in ("execute", "answer"))
    if len(cells) + len(answers) != 1:
        return "malformed", ""
    return ("execute", cells[0].strip()) if cells else ("answer", answers[0].strip())


def clip(text: str, limit: int = CLIP) -> str:
    if len(text) <= limit:
        return text
    a, b = int(limit * 0.7), int(limit * 0.25)
    return f"{text[:a]}\n… ({len(text) - a - b} characters left out) …\n{text[-b:]}"


def now() -> str:
    return datetime.now().astimezone().isoformat(timespec="seconds")


class Session:
    def __init__(self, workspace: str | Path = "workspace", generate: Callable[[list[dict]], str] | None = None, *, allow_code: bool = False, skills_dir: str | Path | None = None, spark: SparkSession | None = None, resume: str | None = None):
        self.spark, self.generate, self.allow_code = spark or spark_session(), generate, allow_code
        root = Path(workspace)
        self.id = resume or datetime.now().strftime("s%Y%m%d-%H%M%S-%f")
        self.folder = root / self.id
        self.transcript = Transcript(self.folder / "transcript.jsonl")
        self.library = Library.load(skills_dir or root / "skills")
        self.tables: dict[str, DataFrame] = {}
        self.datasets: list[dict] = []
        self.history: list[dict] = []
        if resume:
            self._replay()
        else:
            self.transcript.append("session_meta", session=self.id)

    # --- tables -----------------------------------------------------------------------------

    def load(self, path: str, name: str | None = None, **options) -> DataFrame:
        name = name or re.sub(r"\W+", "_", Path(path).stem).strip("_") or "table"
        df = read(path, spark=self.spark, **options)
        digest = _digest(path)
        ev = self.transcript.append("exec", code=f"load {path}", status="ok", kind_note="load", path=str(path), sha256=digest, variable=name)
        self._put(name, df)
        self.datasets.append({"path": str(path), "sha256": digest, "variable": name, "loaded_event": ev})
        self.history.append({"role": "user", "content": f"<dataset variable={name!r}>\n{profile_df(df, name)}\n</dataset>"})
        return df

    def _put(self, name: str, df: DataFrame) -> None:
        self.tables[name] = df
        if len(set(df.columns)) == len(df.columns):
            df.createOrReplaceTempView(name)

    def _replay(self) -> None:
        """Loads again what the log says was loaded; cleaned states come from their files."""
        for e in self.transcript.events():
            if e.get("kind_note") == "load" and Path(e["path"]).exists():
                self._put(e["variable"], read(e["path"], spark=self.spark))
                self.datasets.append({k: e[k] for k in ("path", "sha256", "variable")} | {"loaded_event": e["ev_id"]})
        for saved in sorted((self.folder / "cleaned").glob("*.parquet")):
            self._put(saved.stem, self.spark.read.parquet(str(saved)))

    def registry(self) -> list[dict]:
        return [{"name": n, "type": "DataFrame", "columns": len(df.columns)} for n, df in self.tables.items()]

    # --- questions --------------------------------------------------------------------------

    def ask(self, question: str, decide: Callable[[Gate], object] = by_policy("all")) -> AnswerCard:
        """A gated turn: at most six cells, one of execute or answer a reply, checks lifted from what ran."""
        if not self.generate:
            raise ValueError("this session has no model to ask")
        if not self.allow_code:
            raise PermissionError("answers need code to run; open the session with allow_code=True")
        first = self.transcript.append("user", text=question)
        self.history.append({"role": "user", "content": question})
        self._compact()
        cells, used, nudged, bounced, answer = [], 0, False, False, None
        space = {"spark": self.spark, "F": F, **self.tables}
        while used < MAX_CELLS and answer is None:
            kind, body = parse_tags(self._reply())
            if kind == "malformed":
                used += nudged
                nudged = True
                self._say(NUDGE)
            elif kind == "answer":
                ran = [c for c in cells if c["status"] == "ok"]
                if ran and not passed_checks(ran[-1]["code"]) and not bounced:
                    bounced = True
                    self._say(CHECKS)
                else:
                    answer = body
            else:
                used += 1
                cells.append(self._cell(body, space, decide))
        flags = {"capped": answer is None, "malformed_answer": False}
        if answer is None:
            self._say(FORCED)
            text = self._reply()
            kind, answer = parse_tags(text)
            flags["malformed_answer"] = kind != "answer"
            answer = answer if kind == "answer" else text
        ran = [c for c in cells if c["status"] == "ok"]
        checks = passed_checks(ran[-1]["code"]) if ran else []
        flags["unchecked"] = bool(ran) and not checks
        intent = self._intent(question, ran, answer)
        flags["intent_mismatch"] = intent.get("verdict") == "mismatch"
        number = len(list((self.folder / "cards").glob("*.json"))) + 1
        last = self.transcript.append("card", card_id=f"{self.id}-c{number:03d}", answer=answer, checks=checks)
        chain = [first, *(c["event_id"] for c in cells), last]
        card = AnswerCard(f"{self.id}-c{number:03d}", self.id, question, answer, cells, checks, {"datasets": list(self.datasets), "event_chain": chain}, flags, intent, now())
        card.save(self.folder / "cards")
        return card

    def _reply(self) -> str:
        text = self.generate([{"role": "system", "content": SYSTEM}, *self.history])
        self.transcript.append("model", text=text)
        self.history.append({"role": "assistant", "content": text})
        return text

    def _say(self, text: str) -> None:
        self.history.append({"role": "user", "content": text})

    def _cell(self, code: str, space: dict, decide) -> dict:
        bad = screen(code)
        bad = [b for b in bad if b not in (".collect", ".toPandas")]
        decision = decide(Gate(code, "a cell for the question")) if not bad else ("reject", "refused by the screen: " + ", ".join(bad))
        action, note = decision if isinstance(decision, tuple) else (decision, "")
        ev = self.transcript.append("gate", action=action, note=note)
        if action != "run":
            self._say(f"<observation>the cell was not run: {note or action}</observation>")
            return {"event_id": ev, "code": code, "status": None, "gate": f"{action}: {note}" if note else action}
        out, status = io.StringIO(), "ok"
        try:
            with contextlib.redirect_stdout(out):
                exec(compile(code, "<cell>", "exec"), space)  # noqa: S102
            seen = f"{out.getvalue()}\nresult = {space.get('result')!r}"
        except Exception as e:  # noqa: BLE001
            status, seen = "error", f"{out.getvalue()}\n{type(e).__name__}: {e}"
        ev = self.transcript.append("exec", code=code, status=status, value=clip(seen))
        for name, value in space.items():
            if isinstance(value, DataFrame) and name.isidentifier():
                self.tables[name] = value
        self._say(f"<observation status={status!r}>\n{clip(seen)}\n</observation>")
        return {"event_id": ev, "code": code, "status": status, "gate": "run"}

    def _intent(self, question: str, ran: list[dict], answer: str) -> dict:
        """One more call that reads the code back; a check that cannot be made is no verdict."""
        if not ran:
            return {}
        code = "\n\n".join(c["code"] for c in ran[-2:])
        try:
            text = self.generate([{"role": "system", "content": INTENT}, {"role": "user", "content": f"Question:\n{question}\n\nCode that ran:\n{code}\n\nAnswer:\n{answer}"}])
        except Exception:  # noqa: BLE001
            return {}
        self.transcript.append("model", text=text, kind_note="intent")
        found = {t: (m[1].strip() if (m := re.search(rf"<{t}>(.*?)</{t}>", text, re.S)) else "") for t in ("restatement", "verdict", "reason")}
        return found | {"verdict": "mismatch" if found["verdict"] == "mismatch" else "match"}

    def _compact(self) -> None:
        """Beyond 60,000 characters old messages become one summary; tables and the last messages stay."""
        if sum(len(m["content"]) for m in self.history) <= COMPACT_CHARS:
            return
        old, tail = self.history[:-KEEP_MESSAGES], self.history[-KEEP_MESSAGES:]
        tables = [m for m in old if m["content"].startswith("<dataset")]
        rest = [m for m in old if not m["content"].startswith("<dataset")]
        try:
            said = self.generate([{"role": "system", "content": "Summarise this conversation for its next turn."}, *rest])
        except Exception:  # noqa: BLE001 - rather a long history than a lost one
            return
        self.history = [*tables, {"role": "user", "content": f"<summary>\n{said}\n</summary>"}, *tail]

    # --- cleaning ---------------------------------------------------------------------------

    def clean(self, variable: str, decide: Callable[[Gate], object] = by_policy("auto")) -> CleanReport:
        """Finding by finding: a skill, else a built-in repair, else the model; gate, run, verify, keep or drop."""
        start = self.tables[variable]
        found = detect_all(start, variable)
        working, fixes, events, admitted = start, [], [], []
        todo = [f for f in found.findings if not f.indicator]
        for f in sorted(todo, key=lambda f: ORDER.index(f.disease) if f.disease in ORDER else len(ORDER)):
            working, record = self._repair(working, variable, f, decide, admitted)
            fixes.append(record)
            events += record["transcript_evs"]
        source = next(({k: d[k] for k in ("path", "sha256")} for d in self.datasets if d["variable"] == variable), {})
        number = len(list((self.folder / "clean_reports").glob("*.json"))) + 1
        outputs = {}
        if working.columns and any(x["status"] == "fixed" for x in fixes):
            path = self.folder / "cleaned" / f"{variable}.parquet"
            working.write.mode("overwrite").parquet(str(path))
            lineage = path.with_suffix(".lineage.json")
            lineage.write_text(json.dumps({"source": source, "fixes": fixes, "session": self.id}, indent=2, default=str), "utf-8")
            outputs = {"parquet": str(path), "lineage": str(lineage)}
            self._put(variable, self.spark.read.parquet(str(path)))
        report = CleanReport(
            f"{self.id}-r{number:03d}", self.id, variable, source, fixes, [f.to_dict() for f in found.findings if f.indicator], found.clear, found.broken, outputs, admitted,
            {"columns_before": len(start.columns), "columns_after": len(working.columns)}, events, now(),
        )
        report.save(self.folder / "clean_reports")
        self.library.save()
        return report

    def _repair(self, df: DataFrame, variable: str, f: Finding, decide, admitted: list[str]) -> tuple[DataFrame, dict]:
        record = {"finding": f.to_dict(), "status": "skipped", "attempts": 0, "origin": "", "transcript_evs": [], "reason": "no repair is known"}
        dataset = next((d["sha256"] for d in self.datasets if d["variable"] == variable), "")
        for origin, name, fix, code in self._proposals(f):
            gate = Gate(code, f"d{f.disease:02d} {f.slug} [{', '.join(f.columns)}] by {origin}", preview(df, lambda x, fix=fix: fix(x, f.columns)), f.grade)
            free = name and unattended(self.library.entries[name], f.grade)
            decision = "run" if free else decide(gate)
            action, note = decision if isinstance(decision, tuple) else (decision, "")
            record["transcript_evs"].append(self.transcript.append("gate", action=action, note=note, title=gate.title))
            if action != "run":
                record |= {"status": "skipped", "reason": note or "left for a person"}
                return df, record
            record["attempts"] += 1
            try:
                after = fix(df, f.columns)
                held, why = verify(df, after, f)
            except Exception as e:  # noqa: BLE001
                held, why = False, f"{type(e).__name__}: {e}"
            record["transcript_evs"].append(self.transcript.append("exec", code=code, status="ok" if held else "error", value=why))
            if name and not why.startswith("uncheckable:"):
                self.library.record(name, success=held, dataset=dataset, events=record["transcript_evs"])
            record |= {"status": "fixed" if held else "failed", "origin": origin, "reason": why}
            if held:
                if origin == "model":
                    admitted += self._admit(df, after, f, code)
                return after, record
        return df, record

    def _proposals(self, f: Finding):
        """Ways to repair a finding: (origin, skill name or "", function, code), best first."""
        for entry in self.library.candidates(f.disease)[:SKILL_TRIES]:
            try:
                s = skills.load(self.library.root / entry["name"])
                yield f"skill:{entry['name']}", entry["name"], skills.function(s.fix_source), s.fix_source
            except (OSError, ValueError):
                continue
        if f.disease in FIXES and f.grade == AUTO:
            more = {"family": f.stats["family"]} if f.disease == 2 else {}
            yield "builtin", "", lambda df, columns: FIXES[f.disease](df, columns, **more), f"# built-in repair of d{f.disease:02d}"
            return
        if not (self.generate and self.allow_code):
            return
        messages = [{"role": "system", "content": FIX}, {"role": "user", "content": json.dumps(f.to_dict())}]
        for _ in range(MODEL_TRIES):
            text = self.generate(messages)
            self.transcript.append("model", text=text)
            kind, code = parse_tags(text)
            messages.append({"role": "assistant", "content": text})
            try:
                if kind != "execute":
                    raise ValueError("no <execute> part")
                yield "model", "", skills.function(code), code
                messages.append({"role": "user", "content": "That repair did not verify. Try another."})
            except (ValueError, KeyError, SyntaxError) as e:
                messages.append({"role": "user", "content": f"That cannot be run: {e}"})

    def _admit(self, before: DataFrame, after: DataFrame, f: Finding, code: str) -> list[str]:
        """A model's verified repair as a skill on probation, if it also clears its frozen case."""
        name = f"fix-{f.slug}-{hashlib.sha256(code.encode()).hexdigest()[:6]}"
        # rows carry their number through the repair, so those that a join has moved are paired still
        marked = before.withColumn("__row", F.monotonically_increasing_id())
        moved = skills.function(code)(marked, f.columns)
        case = frozen_case(marked, moved if "__row" in moved.columns else after, f.columns)
        held, _ = admissible(case, skills.function(code), f.disease, f.columns)
        if not held or name in self.library.entries:
            return []
        skills.save(skills.Skill(name, f"Repairs {f.slug} (check {f.disease}) in text like that of {', '.join(f.columns)}.", code, metadata={"disease": str(f.disease)}), self.library.root)
        case.write.mode("overwrite").parquet(str(self.library.root / name / "case"))
        self.library.register(name, f.disease)
        return [name]

    def clean_family(self, pattern: str, name: str, mapping: dict[str, dict[str, str]] | None = None, decide=by_policy("auto")) -> dict:
        """Drift, one schema for all slices, then each slice cleaned."""
        tables = read_family(pattern, self.spark)
        drift = [f.to_dict() for f in detect_family(tables)]
        slices = harmonize(tables, mapping) if tables else {}
        out = {"family": name, "slices": len(slices), "drift": drift, "cleaned": {}}
        for key, df in slices.items():
            variable = slice_variable(name, key)
            self._put(variable, df)
            out["cleaned"][key] = self.clean(variable, decide).counts()
        (self.folder / f"family-{name}.json").write_text(json.dumps(out, indent=2), "utf-8")
        return out

    def why(self, claim: str | None = None) -> str:
        return provenance.to_markdown(provenance.build(self.folder), claim)


def _digest(path: str) -> str:
    p = Path(path)
    h = hashlib.sha256()
    for f in [p] if p.is_file() else sorted(x for x in p.rglob("*") if x.is_file()):
        with f.open("rb") as b:
            while part := b.read(1 << 20):
                h.update(part)
    return h.hexdigest()


def run_clean_once(session: Session, path: str, name: str | None = None, policy: str = "auto") -> dict:
    """A file loaded and cleaned without a person: what ran, what waits for one, and where the results are."""
    session.load(path, name)
    variable = session.datasets[-1]["variable"]
    waiting: list[str] = []
    policy_ = by_policy(policy)

    def decide(g: Gate):
        answer = policy_(g)
        if answer != "run":
            waiting.append(g.title)
        return answer

    report = session.clean(variable, decide)
    waiting += [f"d{x['finding']['disease']:02d} {x['finding']['slug']} [{', '.join(x['finding']['columns'])}]" for x in report.fixes if x["status"] == "skipped" and x["attempts"] == 0 and x["reason"] == "no repair is known"]
    fixes = [{k: x["finding"][k] for k in ("disease", "slug", "grade")} | {"status": x["status"]} for x in report.fixes]
    return {"file": path, "variable": variable, "needs_human": waiting, "fixes": fixes, "outputs": report.outputs, "skills_admitted": report.skills_admitted, "report": str(session.folder / "clean_reports")}
