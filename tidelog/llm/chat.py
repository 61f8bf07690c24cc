"""Chat formatting by compiled templates.

A template is written in a small sandboxed language::

    {{ expression }}                      output, with filters: {{ m.text | escape }}
    {% if e %} {% elif e %} {% else %} {% endif %}
    {% for m in messages %} {% endfor %}
    {% generation %} {% endgeneration %}  marks the text that a model learns to produce

Expressions know string and whole-number literals, the names of the context,
fields of messages and of ``loop`` (index, first, last), ``==``, ``!=``, ``<``,
``not``, ``and``, ``or``, ``+`` and the filters of :data:`FILTERS`. Nothing else
can be reached: there are no calls, indexes or attributes of Python objects.

:func:`compile_template` parses the text into a syntax tree, folds constants
(expressions of literals, neighbouring texts, conditions that are known) and
generates Python closures. Rendering yields the text and the spans of it that
are marked as generation.

A template for conversations has one loop over ``messages`` at its top. What
stands before it goes with the first turn and what stands after with the last,
so each row of the table is rendered by itself: a conversation of any length is
spread over tasks and never held whole. First and last turns come from an
aggregation per conversation. The formatted conversation is its rows' texts in
order of turn.

``escape`` makes control strings and the escape sign itself reversible, so a
text can never be read as a mark; :func:`parse_turn` reads a row's turn back.

Null texts and roles are empty; rows of a null conv_id are one conversation of that null id, and null turns come
first. Texts of any length are one row. Rows of a conversation with equal turns follow
each other by role and text; fully equal ones are all kept. An empty table gives
an empty result. Other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Strings that mark turns or that a text must not bring in unescaped (fixed values).
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|turn|>", "<|say|>", "<|end|>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
_SIGN = "\\"
_CODES = {c: f"{_SIGN}{chr(97 + k)}" for k, c in enumerate(CONTROLS)} | {_SIGN: _SIGN * 2}
_PLAIN = {v[1]: k for k, v in _CODES.items()}
_TO_ESCAPE = re.compile("|".join(re.escape(c) for c in sorted(_CODES, key=len, reverse=True)))
_ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    """``text`` with control strings and the escape sign replaced."""
    return _TO_ESCAPE.sub(lambda m: _CODES[m[0]], text)


def unescape(text: str) -> str:
    """What :func:`escape` was given."""
    return _ESCAPED.sub(lambda m: _PLAIN[m[1]], text)


#: The filters of the language.
FILTERS: dict[str, Callable[[str], str]] = {"escape": escape, "trim": str.strip, "upper": str.upper, "lower": str.lower}

DEFAULT_TEMPLATE = (
    "{% for m in messages %}<|turn|>{{ m.role | escape }}<|say|>"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}"
    "<|end|>{% if not loop.last %}{{ '\\n' }}{% endif %}{% endfor %}"
)


class TemplateError(ValueError):
    """The template isn't of the language."""


# The syntax tree. Nodes of expressions: Const, Name, Op; of texts: Text, Out, If, For, Gen.


@dataclass
class Const:
    value: object


@dataclass
class Name:
    parts: tuple[str, ...]


@dataclass
class Op:
    kind: str
    args: list


@dataclass
class Text:
    text: str


@dataclass
class Out:
    value: object


@dataclass
class If:
    test: object
    then: list
    other: list = field(default_factory=list)


@dataclass
class For:
    name: str
    items: object
    body: list


@dataclass
class Gen:
    body: list


_TAGS = re.compile(r"(\{\{.*?\}\}|\{%.*?%\}|\{#.*?#\})", re.S)
_WORDS = re.compile(r"""\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<int>\d+)|(?P<name>[A-Za-z_][A-Za-z_0-9]*)|(?P<op>==|!=|<|\+|\||\.|\(|\)))""")
_STRING_CODES = {"n": "\n", "t": "\t"}


class _Words:
    """Reads one expression."""

    def __init__(self, text: str):
        self.words, at = [], 0
        while text[at:].strip():
            m = _WORDS.match(text, at)
            if not m:
                raise TemplateError(f"not an expression: {text.strip()}")
            self.words.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def take(self, *values: str) -> str | None:
        if self.at < len(self.words) and self.words[self.at][0] in ("op", "name") and self.words[self.at][1] in values:
            self.at += 1
            return self.words[self.at - 1][1]
        return None

    def _next(self, kind: str) -> str:
        if self.at >= len(self.words) or self.words[self.at][0] != kind:
            raise TemplateError(f"{kind} expected")
        self.at += 1
        return self.words[self.at - 1][1]

    def whole(self):
        e = self.either()
        if self.at < len(self.words):
            raise TemplateError(f"unexpected {self.words[self.at][1]}")
        return e

    def either(self):
        e = self.both()
        while self.take("or"):
            e = Op("or", [e, self.both()])
        return e

    def both(self):
        e = self.negated()
        while self.take("and"):
            e = Op("and", [e, self.negated()])
        return e

    def negated(self):
        return Op("not", [self.negated()]) if self.take("not") else self.compared()

    def compared(self):
        e = self.joined()
        while kind := self.take("==", "!=", "<"):
            e = Op(kind, [e, self.joined()])
        return e

    def joined(self):
        e = self.filtered()
        while self.take("+"):
            e = Op("+", [e, self.filtered()])
        return e

    def filtered(self):
        e = self.single()
        while self.take("|"):
            name = self._next("name")
            if name not in FILTERS:
                raise TemplateError(f"no filter {name}")
            e = Op(f"|{name}", [e])
        return e

    def single(self):
        if self.take("("):
            e = self.either()
            if not self.take(")"):
                raise TemplateError(") expected")
            return e
        if self.at >= len(self.words):
            raise TemplateError("expression expected")
        kind, word = self.words[self.at]
        self.at += 1
        if kind == "str":
            return Const(re.sub(r"\\(.)", lambda m: _STRING_CODES.get(m[1], m[1]), word[1:-1], flags=re.S))
        if kind == "int":
            return Const(int(word))
        if kind != "name" or word in ("and", "or", "not", "in"):
            raise TemplateError(f"unexpected {word}")
        if word in ("true", "false"):
            return Const(word == "true")
        parts = [word]
        while self.take("."):
            parts.append(self._next("name"))
        return Name(tuple(parts))


def parse(template: str) -> list:
    """The syntax tree of a template."""
    pieces = _TAGS.split(template)
    at = 0

    def block(*ends: str) -> tuple[list, str, str]:
        nonlocal at
        out: list = []
        while at < len(pieces):
            piece = pieces[at]
            at += 1
            if piece.startswith("{{"):
                out.append(Out(_Words(piece[2:-2]).whole()))
            elif piece.startswith("{#"):
                continue
            elif piece.startswith("{%"):
                word, _, rest = piece[2:-2].strip().partition(" ")
                if word in ends:
                    return out, word, rest
                if word == "if":
                    out.append(condition(rest))
                elif word == "for":
                    m = re.fullmatch(r"\s*([A-Za-z_]\w*)\s+in\s+(.+)", rest, re.S)
                    if not m:
                        raise TemplateError(f"not a loop: {rest}")
                    out.append(For(m[1], _Words(m[2]).whole(), block("endfor")[0]))
                elif word == "generation":
                    out.append(Gen(block("endgeneration")[0]))
                else:
                    raise TemplateError(f"unexpected {word}")
            elif piece:
                out.append(Text(piece))
        if ends:
            raise TemplateError(f"{ends[-1]} expected")
        return out, "", ""

    def condition(test: str) -> If:
        then, word, rest = block("elif", "else", "endif")
        node = If(_Words(test).whole(), then)
        if word == "elif":
            node.other = [condition(rest)]
        elif word == "else":
            node.other = block("endif")[0]
        return node

    return block()[0]


_OPS: dict[str, Callable] = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "+": lambda a, b: a + b,
    "and": lambda a, b: a and b, "or": lambda a, b: a or b, "not": lambda a: not a,
} | {f"|{k}": f for k, f in FILTERS.items()}


def fold(node):
    """The tree with what is known before rendering computed."""
    if isinstance(node, list):
        out: list = []
        for x in node:
            x = fold(x)
            for y in x if isinstance(x, list) else [x]:
                if isinstance(y, Text) and out and isinstance(out[-1], Text):
                    out[-1] = Text(out[-1].text + y.text)
                elif not (isinstance(y, Text) and not y.text):
                    out.append(y)
        return out
    if isinstance(node, Op):
        args = [fold(a) for a in node.args]
        if all(isinstance(a, Const) for a in args):
            return Const(_OPS[node.kind](*(a.value for a in args)))
        if node.kind in ("and", "or") and isinstance(args[0], Const):
            return args[1] if bool(args[0].value) == (node.kind == "and") else args[0]
        return Op(node.kind, args)
    if isinstance(node, Out):
        e = fold(node.value)
        return Text(str(e.value)) if isinstance(e, Const) else Out(e)
    if isinstance(node, If):
        test = fold(node.test)
        if isinstance(test, Const):
            return fold(node.then if test.value else node.other)
        return If(test, fold(node.then), fold(node.other))
    if isinstance(node, For):
        return For(node.name, fold(node.items), fold(node.body))
    if isinstance(node, Gen):
        body = fold(node.body)
        return Gen(body) if body else []
    return node


class _Page:
    """Text under construction, and the marked spans of it."""

    def __init__(self):
        self.parts: list[str] = []
        self.chars = 0
        self.spans: list[tuple[int, int]] = []

    def add(self, text: str) -> None:
        self.parts.append(text)
        self.chars += len(text)


def _value(node) -> Callable[[dict], object]:
    if isinstance(node, Const):
        return lambda scope, v=node.value: v
    if isinstance(node, Name):
        first, *rest = node.parts

        def look_up(scope):
            v = scope[first]
            for part in rest:
                v = v[part]
            return v

        return look_up
    args, op = [_value(a) for a in node.args], _OPS[node.kind]
    if node.kind == "and":
        return lambda scope: args[0](scope) and args[1](scope)
    if node.kind == "or":
        return lambda scope: args[0](scope) or args[1](scope)
    if len(args) == 1:
        return lambda scope, a=args[0]: op(a(scope))
    return lambda scope, a=args[0], b=args[1]: op(a(scope), b(scope))


def _writer(nodes: list) -> Callable[[dict, _Page], None]:
    steps = [_step(n) for n in nodes]

    def write(scope: dict, page: _Page) -> None:
        for step in steps:
            step(scope, page)

    return steps[0] if len(steps) == 1 else write


def _step(node) -> Callable[[dict, _Page], None]:
    if isinstance(node, Text):
        return lambda scope, page, t=node.text: page.add(t)
    if isinstance(node, Out):
        value = _value(node.value)
        return lambda scope, page: page.add(str(value(scope)))
    if isinstance(node, If):
        test, then, other = _value(node.test), _writer(node.then), _writer(node.other)
        return lambda scope, page: (then if test(scope) else other)(scope, page)
    if isinstance(node, Gen):
        body = _writer(node.body)

        def generation(scope: dict, page: _Page) -> None:
            start = page.chars
            body(scope, page)
            page.spans.append((start, page.chars))

        return generation
    items, body = _value(node.items), _writer(node.body)

    def loop(scope: dict, page: _Page) -> None:
        rows = list(items(scope))
        for k, row in enumerate(rows):
            body(scope | {node.name: row, "loop": {"index": k + 1, "first": k == 0, "last": k == len(rows) - 1}}, page)

    return loop


@dataclass
class Template:
    """A compiled template: ``render`` for whole conversations, ``render_turn`` for one row of it."""

    tree: list

    def __post_init__(self):
        self._whole = _writer(self.tree)
        loops = [k for k, n in enumerate(self.tree) if isinstance(n, For) and n.items == Name(("messages",))]
        self._split = None
        if len(loops) == 1:
            k = loops[0]
            self._split = self.tree[k].name, _writer(self.tree[:k]), _writer(self.tree[k].body), _writer(self.tree[k + 1 :])

    def render(self, messages: list[dict]) -> tuple[str, list[tuple[int, int]]]:
        """The text of a conversation and its marked spans."""
        page = _Page()
        self._whole({"messages": messages}, page)
        return "".join(page.parts), page.spans

    def render_turn(self, message: dict, index: int, first: bool, last: bool) -> tuple[str, list[tuple[int, int]]]:
        """What one message adds to its conversation's text, with spans in that."""
        if not self._split:
            raise TemplateError("a template for rows has one loop over messages, at its top")
        name, before, body, after = self._split
        page = _Page()
        if first:
            before({}, page)
        body({name: message, "loop": {"index": index, "first": first, "last": last}}, page)
        if last:
            after({}, page)
        return "".join(page.parts), page.spans


def compile_template(template: str) -> Template:
    """Parse, fold and generate."""
    return Template(fold(parse(template)))


def parse_turn(formatted: str) -> tuple[str, str]:
    """Role and text of a row that :data:`DEFAULT_TEMPLATE` formatted."""
    role, _, rest = formatted.partition("<|turn|>")[2].partition("<|say|>")
    return unescape(role), unescape(rest[: rest.index("<|end|>")])


FORMATTED = "conv_id long, turn long, nth int, formatted string, loss array<struct<start:int,end:int>>"


#: Turns of a conversation that lie in one task.
TURNS_TOGETHER = 64


def format_rows(conversations: DataFrame, template: str = DEFAULT_TEMPLATE) -> DataFrame:
    """Every row's part of its conversation's text: conv_id, turn, nth, formatted and loss spans.

    ``loop.index`` is the turn's number less the conversation's first one, plus
    one. Rows with a conversation's highest turn share its last place; ``nth``
    orders rows with equal turns, so only one of them is first or last.

    Texts are exchanged once, by conversation and a stretch of its turns; first and last turns are found from the
    numbers alone and meet them there.
    """
    compile_template(template)
    rows = conversations.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    stretch = F.coalesce(F.floor(F.col("turn") / TURNS_TOGETHER), F.lit(-1)).cast("long")
    named = F.coalesce("conv_id", F.lit(0)).alias("_conv"), F.col("conv_id").isNull().alias("_none"), stretch.alias("_stretch")
    numbers = rows.select("turn", *named).groupBy("_conv", "_none", "_stretch").agg(F.min("turn").alias("low"), F.max("turn").alias("high"))
    whole = numbers.groupBy("_conv", "_none").agg(F.min("low").alias("first"), F.max("high").alias("last"))
    ends = numbers.join(whole, ["_conv", "_none"]).select("_conv", "_none", "_stretch", "first", "last")
    keys = ["_conv", "_none", "_stretch"]
    met = rows.select("*", *named).join(ends, keys)
    together = Window.partitionBy(*keys, "turn")
    order = together.orderBy("role", "text")
    placed = met.withColumn("nth", F.row_number().over(order) - 1).withColumn("after", F.count(F.lit(1)).over(together) - F.col("nth") - 1).select(
        "conv_id", "turn", "nth", "role", "text", "after",
        F.col("turn").eqNullSafe(F.col("first")).alias("at_first"), F.col("turn").eqNullSafe(F.col("last")).alias("at_last"),
        (F.coalesce(F.col("turn") - F.col("first"), F.lit(0)) + 1).alias("index"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = compile_template(template)
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for conv, turn, nth, role, text, after, at_first, at_last, index in zip(*(c.to_pylist() for c in batch.columns)):
                formatted, spans = compiled.render_turn({"role": role, "text": text, "turn": turn}, index, at_first and nth == 0, at_last and after == 0)
                for column, value in zip(out, (conv, turn, nth, formatted, [{"start": a, "end": b} for a, b in spans])):
                    column.append(value)
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], ["conv_id", "turn", "nth", "formatted", "loss"])

    return placed.mapInArrow(run, FORMATTED)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digest(formatted: DataFrame) -> DataFrame:
    """Digests of each conversation, read back from its formatted rows.

    A hash of a whole text is computed in its order, so a conversation's rows
    meet in one task; they stream through it sorted, a batch at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, started = None, False
        turns = loss = None
        counts = [0, 0, 0]

        def row() -> pa.RecordBatch:
            values = [now, counts[0], turns.hexdigest(), counts[1], loss.hexdigest(), counts[2]]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()))], [c.split()[0] for c in DIGEST.split(", ")])

        for batch in batches:
            for conv, text, spans in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if not started or conv != now:
                    if started:
                        yield row()
                    now, started = conv, True
                    turns, loss, counts[:] = hashlib.sha256(), hashlib.sha256(), (0, 0, 0)
                role, said = parse_turn(text)
                turns.update(f"{role}\n{said}\n".encode())
                learnt = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
                loss.update(learnt.encode())
                counts[:] = counts[0] + 1, counts[1] + len(learnt), counts[2] + len(text)
        if started:
            yield row()

    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "nth")
    return ordered.select("conv_id", "formatted", "loss").mapInArrow(run, DIGEST)
