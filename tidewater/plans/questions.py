"""Questions in plain English about one table, read piece by piece: measures, groups, conditions, order.

Every piece names columns of the table; what is left over must be words without meaning of their own, else the question is
refused. So a question is either understood whole or not answered.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

MEASURES = {
    "average": "AVG", "mean": "AVG", "total": "SUM", "sum": "SUM", "highest": "MAX", "largest": "MAX", "maximum": "MAX", "max": "MAX", "latest": "MAX", "lowest": "MIN", "smallest": "MIN", "minimum": "MIN",
    "min": "MIN", "earliest": "MIN", "median": "MEDIAN",
}
COMPARED = {
    "at least": ">=", "no less than": ">=", "at most": "<=", "no more than": "<=", "more than": ">", "greater than": ">", "larger than": ">", "over": ">", "above": ">", "after": ">", "less than": "<", "smaller than": "<",
    "under": "<", "below": "<", "before": "<", "is not": "<>", "are not": "<>", "not equal to": "<>", "other than": "<>", "equal to": "=", "equals": "=", "is": "=", "are": "=", "=": "=", ">=": ">=", "<=": "<=", ">": ">", "<": "<",
}
EMPTY_WORDS = frozenset("a an the of in on for from all is are was were there what which who how does do did have has with where whose that and me show list give find get rows row records record entries please values value their its it to each every table data by".split())
_VALUE = r"(?:'(?:[^']|'')*'|\"[^\"]*\"|-?\d+(?:\.\d+)?(?![\w-])|[\w.@/:-]+)"


@dataclass
class Question:
    """What a question asks of a table."""

    table: str
    measures: list[str] = field(default_factory=list)
    groups: list[str] = field(default_factory=list)
    conditions: list[str] = field(default_factory=list)
    columns: list[str] = field(default_factory=list)
    order: str = ""
    limit: int | None = None

    def sql(self) -> str:
        select = [*self.groups, *self.measures] if self.measures or self.groups else self.columns or ["*"]
        if self.groups and not self.measures:
            select.append("COUNT(*) AS row_count")
        out = f"SELECT {', '.join(select)} FROM {_quoted(self.table)}"
        out += f" WHERE {' AND '.join(self.conditions)}" if self.conditions else ""
        out += f" GROUP BY {', '.join(self.groups)}" if self.groups else ""
        return out + (f" ORDER BY {self.order}" if self.order else "") + (f" LIMIT {self.limit}" if self.limit else "")


def _quoted(name: str) -> str:
    return name if re.fullmatch(r"\w+", name) else ".".join(x if re.fullmatch(r"\w+", x) else "`" + x.replace("`", "``") + "`" for x in name.split("."))


def _phrases(columns: list[str]) -> dict[str, str]:
    """How columns may be called: their names, with spaces, and without a prefix of one or two letters; only what names one."""
    out: dict[str, set[str]] = {}
    for c in columns:
        low = c.lower()
        for x in (low, low.replace("_", " "), re.sub(r"^[a-z]{1,2}_", "", low).replace("_", " ")):
            out.setdefault(x, set()).add(c)
    return {k: next(iter(v)) for k, v in out.items() if len(v) == 1}


def _literal(text: str) -> str:
    if text[:1] in "'\"":
        text = text[1:-1].replace("''", "'")
    elif re.fullmatch(r"-?\d+(\.\d+)?", text):
        return text
    return "'" + text.replace("'", "''") + "'"


def understand(question: str, tables: dict[str, list[str]]) -> Question | None:
    """The question, or None if any word of it isn't accounted for. tables: columns by table name.

    Values are taken as they are written; quotes keep their case and spaces. A question that names no table is about the only
    one there is.
    """
    text = " " + re.sub(r"\s+", " ", question.strip().rstrip("?.!")) + " "
    named = [t for t in tables if re.search(rf"(?<!\w){re.escape(t)}s?(?!\w)", text, re.I) or re.search(rf"(?<!\w){re.escape(t.removesuffix('s'))}(?!\w)", text, re.I)]
    table = max(named, key=len) if named else next(iter(tables)) if len(tables) == 1 else None
    if table is None:
        return None
    phrases = _phrases(tables[table])
    column = "(?:" + "|".join(re.escape(p) + "(?:s|es)?" for p in sorted(phrases, key=len, reverse=True)) + r")(?!\w)"
    name = lambda x: _quoted(next(phrases[y] for y in (x.lower(), x.lower().removesuffix("s"), x.lower().removesuffix("es")) if y in phrases))
    out = Question(table)

    def take(pattern: str, use) -> None:
        nonlocal text

        def replaced(m: re.Match) -> str:
            return " \x00 " if use(m) is not False else m[0]

        text = re.sub(rf"(?<![\w'\"])(?:{pattern})", replaced, text, flags=re.I)

    def compared(m: re.Match) -> bool | None:
        if m["v"].lower() in (*EMPTY_WORDS, table.lower(), "not", "missing", "null", "empty", "between", *MEASURES):
            return False
        out.conditions.append(f"{name(m['c'])} {COMPARED[' '.join(m['o'].lower().split()) or '=']} {_literal(m['v'])}")
        return None

    like = {"contains": "%{}%", "containing": "%{}%", "starts with": "{}%", "starting with": "{}%", "ends with": "%{}", "ending with": "%{}"}
    take(rf"(?P<c>{column}) (?:is |are )?between (?P<a>{_VALUE}) and (?P<b>{_VALUE})", lambda m: out.conditions.append(f"{name(m['c'])} BETWEEN {_literal(m['a'])} AND {_literal(m['b'])}"))
    take(rf"(?P<c>{column}) (?P<o>{'|'.join(like)}) (?P<v>{_VALUE})", lambda m: out.conditions.append(f"{name(m['c'])} LIKE '{like[m['o'].lower()].format(_literal(m['v']).strip(chr(39)))}'"))
    take(rf"(?P<c>{column}) (?:is |are )?(?P<n>not )?(?:missing|null|empty|blank)(?!\w)", lambda m: out.conditions.append(f"{name(m['c'])} IS {'NOT ' if m['n'] else ''}NULL"))
    take(rf"(?:missing|empty|no|without) (?P<c>{column})", lambda m: out.conditions.append(f"{name(m['c'])} IS NULL"))
    operators = "|".join(re.escape(o) for o in sorted(COMPARED, key=len, reverse=True))
    take(rf"(?P<c>{column}) (?:is |are )?(?P<o>{operators}) (?P<v>{_VALUE})", compared)
    take(rf"(?:with|have|has|having|where|whose) (?P<c>{column}) (?P<o>)(?P<v>{_VALUE})", compared)
    take(r"(?:the )?(?P<w>top|first|bottom|last) (?P<n>\d+)(?!\w)", lambda m: setattr(out, "limit", int(m["n"])) or setattr(out, "order", "DESC" if m["w"].lower() == "top" else "ASC" if m["w"].lower() == "bottom" else ""))
    if out.limit is not None:
        take(rf"(?:by|with the (?:highest|largest|lowest|smallest)|ordered by|sorted by) (?P<c>{column})", lambda m: setattr(out, "order", f"{name(m['c'])} {'ASC' if re.search('lowest|smallest', m[0], re.I) else out.order or 'ASC'}"))
        if out.order in ("DESC", "ASC"):
            return None  # the top of what?
    take(rf"(?:per|by|for each|for every|in each|grouped by) (?P<c>{column}(?: and {column})*)", lambda m: out.groups.extend(name(x) for x in m["c"].split(" and ")))
    take(rf"(?:how many|number of|count of|count) (?:different|distinct|unique) (?P<c>{column})", lambda m: out.measures.append(f"COUNT(DISTINCT {name(m['c'])}) AS distinct_{name(m['c']).strip('`')}"))
    take(rf"(?P<f>{'|'.join(MEASURES)})(?: of)?(?: the)? (?P<c>{column})", lambda m: out.measures.append(f"{MEASURES[m['f'].lower()]}({name(m['c'])}) AS {m['f'].lower()}_{name(m['c']).strip('`')}"))
    take(r"(?:how many|number of|count of|count|row count)(?!\w)", lambda m: out.measures.append("COUNT(*) AS row_count"))
    take(rf"(?:sorted by|ordered by|order by) (?P<c>{column})(?P<d> descending)?", lambda m: setattr(out, "order", f"{name(m['c'])} {'DESC' if m['d'] else 'ASC'}"))
    take(rf"(?P<c>{column})", lambda m: out.columns.append(name(m["c"])))
    left = re.sub(rf"(?<!\w)(?:{re.escape(table)}s?|{re.escape(table.removesuffix('s'))})(?!\w)", " ", text, flags=re.I)
    if any(w not in EMPTY_WORDS and w != "\x00" for w in re.sub(r"[,;]", " ", left.lower()).split()):
        return None
    if out.measures and out.columns or not (out.measures or out.groups or out.conditions or out.columns or out.limit):
        return None
    return out


__all__ = ["Question", "understand"]
