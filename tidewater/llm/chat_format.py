r"""Chat formatting by a compiled template language.

A template is text with `{{ expression }}`, `{% set x = expression %}`, `{% if %} .. {% elif %} .. {% else %} .. {% endif %}`,
`{% for x in expression %} .. {% endfor %}` and `{% generation %} .. {% endgeneration %}` (what a model is trained on). It is
parsed to a syntax tree, constants are folded, and Python closures are made of the rest. Expressions have literals, names,
field access (`a.b`, `a['b']`), `not - * / % + ~ == != < <= > >= in and or` and filters (`x | escape`). The language is
sandboxed: fields are looked up in dicts and lists only, nothing can be called, there is no way to Python's attributes.

Rendering is a stream: loops take iterators, so a conversation of any length is rendered, read back and digested turn by turn.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import partitions

# Control strings that texts may not contain as they are.
CONTROLS = ("<|im_start|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>")
START, END = "<|im_start|>", "<|im_end|>"

CHAT = (
    "{% for message in messages %}<|im_start|>{{ message.role | escape_line }}\n"
    "{% if message.role == 'assistant' %}{% generation %}{{ message.text | escape }}{% endgeneration %}"
    "{% else %}{{ message.text | escape }}{% endif %}<|im_end|>\n{% endfor %}"
    "{% if add_generation_prompt %}<|im_start|>assistant\n{% endif %}"
)

_control = re.compile("|".join([r"\\", *map(re.escape, sorted(CONTROLS, key=len, reverse=True))]))
_escaped = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    r"""Doubles backslashes and puts one after the first character of each control string."""
    return _control.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text)


def escape_line(text: str) -> str:
    return escape(text).replace("\n", "\\n")


def unescape(text: str) -> str:
    """Undoes escape and escape_line."""
    return _escaped.sub(lambda m: "\n" if m[1] == "n" else m[1], text)


class TemplateError(ValueError):
    """A template that can't be parsed, or a value it can't render."""


FILTERS: dict[str, Callable[[Any], Any]] = {
    "escape": lambda x: escape(str(x)), "escape_line": lambda x: escape_line(str(x)), "trim": lambda x: str(x).strip(), "upper": lambda x: str(x).upper(), "lower": lambda x: str(x).lower(), "length": len,
}


@dataclass
class Node:
    """kind, and what it holds: other nodes, lists of nodes, or plain values."""

    kind: str
    args: list = field(default_factory=list)


_tags = re.compile(r"\{\{(.*?)\}\}|\{%-?(.*?)-?%\}|\{#.*?#\}", re.S)
_tokens = re.compile(r"\s*(?:(\d+)|('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|([A-Za-z_]\w*)|(==|!=|<=|>=|[-+*/%~<>|.()\[\],]))", re.S)
# Precedence of binary operators.
_binary = {"or": 1, "and": 2, "==": 3, "!=": 3, "<": 3, "<=": 3, ">": 3, ">=": 3, "in": 3, "+": 4, "-": 4, "~": 4, "*": 5, "/": 5, "%": 5}
_apply: dict[str, Callable[[Any, Any], Any]] = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "in": lambda a, b: a in b,
    "+": lambda a, b: a + b, "-": lambda a, b: a - b, "~": lambda a, b: f"{a}{b}", "*": lambda a, b: _sized(a) * _sized(b), "/": lambda a, b: a / b, "%": lambda a, b: _sized(a) % b,
}
_literals = {"true": True, "false": False, "none": None}


def _sized(x: Any) -> Any:
    if not isinstance(x, (int, float)) or isinstance(x, int) and abs(x) > 1 << 62:
        raise TemplateError("numbers only")
    return x


class _Expression:
    """Recursive-descent parser of one expression."""

    def __init__(self, source: str):
        self.items: list[tuple[str, str]] = []
        at, source = 0, source.rstrip()
        while at < len(source):
            if not (m := _tokens.match(source, at)):
                raise TemplateError(f"can't read {source[at:]!r}")
            self.items.append((("number", "string", "name", "sign")[m.lastindex - 1], m[m.lastindex]))
            at = m.end()
        self.at = 0

    def peek(self) -> str | None:
        return self.items[self.at][1] if self.at < len(self.items) and self.items[self.at][0] != "string" else None

    def take(self, what: str | None = None) -> tuple[str, str]:
        if self.at >= len(self.items) or what and self.peek() != what:
            raise TemplateError(f"{what or 'a value'} is missing")
        self.at += 1
        return self.items[self.at - 1]

    def parse(self) -> Node:
        node = self.binary(0)
        if self.at < len(self.items):
            raise TemplateError(f"unexpected {self.items[self.at][1]!r}")
        return node

    def binary(self, least: int) -> Node:
        if self.peek() == "not":
            self.take()
            left = Node("not", [self.binary(3)])
        else:
            left = self.filtered()
        while (sign := self.peek()) in _binary and _binary[sign] > least:
            self.take()
            right = self.binary(_binary[sign])
            left = Node(sign if sign in ("and", "or") else "binary", [left, right] if sign in ("and", "or") else [sign, left, right])
        return left

    def filtered(self) -> Node:
        node = self.value()
        while (sign := self.peek()) in (".", "[", "|"):
            self.take()
            if sign == "[":
                node = Node("field", [node, self.binary(0)])
                self.take("]")
            else:
                kind, name = self.take()
                if kind != "name" or name.startswith("_") or sign == "|" and name not in FILTERS:
                    raise TemplateError(f"{name!r} is not allowed here")
                node = Node("filter", [name, node]) if sign == "|" else Node("field", [node, Node("const", [name])])
        return node

    def value(self) -> Node:
        kind, x = self.take()
        if kind == "number":
            return Node("const", [int(x)])
        if kind == "string":
            return Node("const", [re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), x[1:-1], flags=re.S)])
        if x == "(":
            node = self.binary(0)
            self.take(")")
            return node
        if x == "-":
            return Node("binary", ["-", Node("const", [0]), self.filtered()])
        if kind == "name" and x not in ("and", "or", "not", "in") and not x.startswith("_"):
            return Node("const", [_literals[x]]) if x in _literals else Node("name", [x])
        raise TemplateError(f"unexpected {x!r}")


def parse(source: str) -> list[Node]:
    """Syntax tree of a template."""
    top: list[Node] = []
    open_tags: list[tuple[str, Node | None, list[Node]]] = [("", None, top)]
    at = 0
    for m in _tags.finditer(source):
        body = open_tags[-1][2]
        if m.start() > at:
            body.append(Node("text", [source[at : m.start()]]))
        at = m.end()
        if m[1] is not None:
            body.append(Node("print", [_Expression(m[1]).parse()]))
        elif m[2] is not None:
            word, _, rest = m[2].strip().partition(" ")
            if word == "set" and (x := re.fullmatch(r"\s*([A-Za-z]\w*)\s*=(.*)", rest, re.S)):
                body.append(Node("set", [x[1], _Expression(x[2]).parse()]))
            elif word == "for" and (x := re.fullmatch(r"\s*([A-Za-z]\w*)\s+in\s+(.*)", rest, re.S)):
                open_tags.append(("for", node := Node("for", [x[1], _Expression(x[2]).parse(), []]), node.args[2]))
                body.append(node)
            elif word == "generation":
                open_tags.append(("generation", node := Node("generation", [[]]), node.args[0]))
                body.append(node)
            elif word == "if":
                open_tags.append(("if", node := Node("if", [_Expression(rest).parse(), [], []]), node.args[1]))
                body.append(node)
            elif word == "elif" and open_tags[-1][0] in ("if", "elif"):
                inner = Node("if", [_Expression(rest).parse(), [], []])
                open_tags[-1][1].args[2].append(inner)
                open_tags.append(("elif", inner, inner.args[1]))
            elif word == "else" and open_tags[-1][0] in ("if", "elif"):
                kind, node, _ = open_tags.pop()
                open_tags.append((kind + "-else", node, node.args[2]))
            elif word in ("endfor", "endif", "endgeneration"):
                while open_tags[-1][0].startswith("elif"):
                    open_tags.pop()
                if open_tags[-1][0].removesuffix("-else") != word[3:]:
                    raise TemplateError(f"{word} without its beginning")
                open_tags.pop()
            else:
                raise TemplateError(f"unknown tag {m[2]!r}")
    if len(open_tags) > 1:
        raise TemplateError(f"{open_tags[-1][0]} has no end")
    if at < len(source):
        top.append(Node("text", [source[at:]]))
    return top


def _truth(x: Any) -> bool:
    return bool(x)


def _get(x: Any, key: Any) -> Any:
    """Field of a dict or item of a list; whatever isn't there is none."""
    if isinstance(x, dict):
        return x.get(key)
    if isinstance(x, list) and isinstance(key, int):
        return x[key] if -len(x) <= key < len(x) else None
    return None


def fold(nodes: list[Node], known: dict[str, Any]) -> list[Node]:
    """The same template with constant expressions computed, dead branches gone and neighbouring texts joined.

    known: names whose values are fixed now, unless the template assigns to them.
    """
    assigned = set(_assigned(nodes))
    return _fold_list(nodes, {k: v for k, v in known.items() if k not in assigned})


def _assigned(nodes: list[Node]) -> Iterator[str]:
    for n in nodes:
        if n.kind in ("set", "for"):
            yield n.args[0]
        for x in n.args:
            if isinstance(x, list):
                yield from _assigned(x)


def _fold_list(nodes: list[Node], known: dict[str, Any]) -> list[Node]:
    out: list[Node] = []
    for n in nodes:
        for x in _fold_statement(n, known):
            if x.kind == "text" and out and out[-1].kind == "text":
                out[-1] = Node("text", [out[-1].args[0] + x.args[0]])
            elif x.kind != "text" or x.args[0]:
                out.append(x)
    return out


def _fold_statement(n: Node, known: dict[str, Any]) -> list[Node]:
    if n.kind == "print":
        x = _fold_expression(n.args[0], known)
        return [Node("text", [_show(x.args[0])])] if x.kind == "const" else [Node("print", [x])]
    if n.kind == "if":
        x = _fold_expression(n.args[0], known)
        if x.kind == "const":
            return _fold_list(n.args[1] if x.args[0] else n.args[2], known)
        return [Node("if", [x, _fold_list(n.args[1], known), _fold_list(n.args[2], known)])]
    if n.kind == "for":
        return [Node("for", [n.args[0], _fold_expression(n.args[1], known), _fold_list(n.args[2], known)])]
    if n.kind == "generation":
        return [Node("generation", [_fold_list(n.args[0], known)])]
    if n.kind == "set":
        return [Node("set", [n.args[0], _fold_expression(n.args[1], known)])]
    return [n]


def _fold_expression(n: Node, known: dict[str, Any]) -> Node:
    if n.kind == "name":
        return Node("const", [known[n.args[0]]]) if n.args[0] in known else n
    parts = [_fold_expression(x, known) if isinstance(x, Node) else x for x in n.args]
    folded = Node(n.kind, parts)
    if n.kind != "const" and all(x.kind == "const" for x in parts if isinstance(x, Node)):
        try:
            return Node("const", [_compiled(folded)({})])
        except Exception:  # it fails when it is rendered, if it is
            return folded
    return folded


def _show(x: Any) -> str:
    return "" if x is None else x if isinstance(x, str) else str(x)


def _compiled(n: Node) -> Callable[[dict], Any]:
    """Closure of an expression: names -> value."""
    if n.kind == "const":
        value = n.args[0]
        return lambda names: value
    if n.kind == "name":
        name = n.args[0]
        return lambda names: names.get(name)
    if n.kind == "field":
        of, key = map(_compiled, n.args)
        return lambda names: _get(of(names), key(names))
    if n.kind == "filter":
        run, x = FILTERS[n.args[0]], _compiled(n.args[1])
        return lambda names: run(x(names))
    if n.kind == "not":
        x = _compiled(n.args[0])
        return lambda names: not x(names)
    if n.kind in ("and", "or"):
        a, b = map(_compiled, n.args)
        return (lambda names: a(names) and b(names)) if n.kind == "and" else (lambda names: a(names) or b(names))
    run, a, b = _apply[n.args[0]], *map(_compiled, n.args[1:])
    return lambda names: run(a(names), b(names))


#: What rendering yields: text, and whether it is generated by the model.
Pieces = Iterator[tuple[str, bool]]
Render = Callable[[dict, bool], Pieces]


def _block(nodes: list[Node]) -> Render:
    parts = [_statement(n) for n in nodes]

    def run(names: dict, marked: bool) -> Pieces:
        for part in parts:
            yield from part(names, marked)

    return run


def _statement(n: Node) -> Render:
    if n.kind == "text":
        text = n.args[0]
        return lambda names, marked: iter(((text, marked),))
    if n.kind == "print":
        x = _compiled(n.args[0])
        return lambda names, marked: iter(((_show(x(names)), marked),))
    if n.kind == "generation":
        inner = _block(n.args[0])
        return lambda names, marked: inner(names, True)
    if n.kind == "set":
        name, value = n.args[0], _compiled(n.args[1])

        def assign(names: dict, marked: bool) -> Pieces:
            names[name] = value(names)
            return iter(())

        return assign
    if n.kind == "if":
        test, then, other = _compiled(n.args[0]), _block(n.args[1]), _block(n.args[2])
        return lambda names, marked: then(names, marked) if _truth(test(names)) else other(names, marked)
    name, items, body = n.args[0], _compiled(n.args[1]), _block(n.args[2])

    def loop(names: dict, marked: bool) -> Pieces:
        source = items(names)
        if source is None or isinstance(source, (str, dict)) or not isinstance(source, Iterable):
            raise TemplateError(f"can't loop over {type(source).__name__}")
        inner, index, nothing = dict(names), 0, object()
        source = iter(source)
        item = next(source, nothing)
        while item is not nothing:
            after = next(source, nothing)
            inner[name] = item
            inner["loop"] = {"index": index + 1, "index0": index, "first": index == 0, "last": after is nothing}
            yield from body(inner, marked)
            item, index = after, index + 1

    return loop


class Template:
    """A compiled template. fixed: names whose values are folded in."""

    def __init__(self, source: str = CHAT, fixed: dict[str, Any] | None = None):
        self.tree = fold(parse(source), fixed or {})
        self.run = _block(self.tree)

    def stream(self, **names: Any) -> Pieces:
        """Pieces of the output, in order, with their generation marks."""
        return self.run(dict(names), False)

    def render(self, **names: Any) -> tuple[str, list[tuple[int, int]]]:
        """The output and the spans (start, end in code points) between generation markers, neighbouring pieces joined."""
        text: list[str] = []
        spans: list[tuple[int, int]] = []
        at = 0
        for x, marked in self.stream(**names):
            if marked and x:
                spans = [*spans[:-1], (spans[-1][0], at + len(x))] if spans and spans[-1][1] == at else [*spans, (at, at + len(x))]
            text.append(x)
            at += len(x)
        return "".join(text), spans


def read_turns(pieces: Pieces) -> Iterator[tuple[str, str, list[str], int]]:
    """Reads an output of CHAT back, a turn at a time: role, text, texts under the loss mask, code points of the output.

    Only the output's characters and their marks are used. A turn is complete when its end marker and line end are there.
    """
    buffer, marks, length = "", [], 0
    for x, marked in pieces:
        if marked:
            marks.append((len(buffer), len(buffer) + len(x)))
        buffer += x
        while buffer.startswith(START) and (end := buffer.find(END, len(START))) >= 0 and len(buffer) > end + len(END):
            role, _, text = buffer[len(START) : end].partition("\n")
            stop = end + len(END) + 1
            if buffer[stop - 1] != "\n":
                raise TemplateError("a turn has no line end")
            yield unescape(role), unescape(text), [unescape(buffer[a:b]) for a, b in marks], stop
            buffer, marks, length = buffer[stop:], [], length + stop
    if buffer:
        raise TemplateError("the output ends inside a turn")


#: One more conversation that op9 formats: both turns hold control strings of another template.
EXTRA = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


@dataclass
class _Digest:
    conv_id: int | None
    turns: Any = field(default_factory=hashlib.sha256)
    loss: Any = field(default_factory=hashlib.sha256)
    n_turns: int = 0
    loss_chars: int = 0
    formatted_chars: int = 0

    def add(self, role: str, text: str, learned: list[str], size: int) -> None:
        self.turns.update(f"{role}\n{text}\n".encode())
        self.n_turns += 1
        for x in learned:
            self.loss.update(x.encode())
            self.loss_chars += len(x)
        self.formatted_chars += size

    def row(self) -> tuple:
        return self.conv_id, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.formatted_chars


def _in_turn(conversations: DataFrame) -> DataFrame:
    """Rows of a conversation together, in order of turn (null first), then role and text."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.repartition(partitions(rows.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def chat_format(conversations: DataFrame, template: str = CHAT, fixed: dict[str, Any] | None = None) -> DataFrame:
    """One row per turn of every conversation: conv_id, turn, position, formatted, spans (array of start and end in
    formatted) under the loss mask. The positions' texts in order are the conversation's output.

    Null roles and texts count as empty; rows that repeat a turn are turns of their own, ordered by role and text; a null
    conv_id is a conversation; an empty table gives no rows. template must render each message by itself, in a loop over
    messages, as CHAT does.
    """
    fixed = {"add_generation_prompt": False} | (fixed or {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled, last, position = Template(template, fixed), object(), 0
        for batch in batches:
            out: list[tuple] = []
            for conv, turn, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                position, last = (position + 1, last) if conv == last else (0, conv)
                formatted, spans = compiled.render(messages=[{"role": role, "text": text}])
                out.append((conv, turn, position, formatted, [{"start": a, "end": b} for a, b in spans]))
            if out:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], ["conv_id", "turn", "position", "formatted", "spans"])

    return _in_turn(conversations).mapInArrow(run, "conv_id long, turn long, position long, formatted string, spans array<struct<start: long, end: long>>")


def chat_digests(conversations: DataFrame, template: str = CHAT) -> DataFrame:
    """Formats every conversation, reads its output back turn by turn and digests what was read: conv_id, n_turns,
    turns_sha256, loss_chars, loss_sha256, formatted_chars. A conversation of any length takes a turn's memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled, now, out = Template(template, {"add_generation_prompt": False}), None, []

        def flush() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            batch = pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
            out.clear()
            return batch

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            ids, start = columns[0], 0
            while start < len(ids):
                end = start
                while end < len(ids) and ids[end] == ids[start]:
                    end += 1
                if now is None or now.conv_id != ids[start]:
                    if now is not None:
                        out.append(now.row())
                    now = _Digest(ids[start])
                messages = ({"role": columns[2][i], "text": columns[3][i]} for i in range(start, end))
                for turn in read_turns(compiled.stream(messages=messages)):
                    now.add(*turn)
                start = end
            if out:
                yield flush()
        if now is not None:
            out.append(now.row())
            yield flush()

    return _in_turn(conversations).mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op9_chat_format(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of all conversations and EXTRA.

    A null role or text is empty; an empty table leaves EXTRA alone. Rows of a conversation are taken by turn, of equal turns by
    role, then text; repeated rows are turns each. A null conv_id is a conversation of its own. Very long texts are formatted
    in a stream, turn by turn. Other columns play no part.
    """
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    return chat_digests(rows.unionByName(spark.createDataFrame(EXTRA, "conv_id long, turn long, role string, text string")))


ORACLE = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')) AS e(conv_id, turn, role, text)),
x AS (SELECT *, length(role) + (length(role) - length(replace(role, '\', ''))) AS role_chars, length(text) + (length(text) - length(replace(text, '\', '')))
    + len(regexp_extract_all(text, '<\|im_start\|>|<\|im_end\|>|<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>|<\|endoftext\|>')) AS text_chars FROM c)
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(role_chars + text_chars + 24) AS BIGINT) AS formatted_chars
FROM x GROUP BY conv_id
"""
