"""Operator 7: chat formatting by a template compiler.

A small sandboxed template language is parsed into a syntax tree, constants are folded, and the tree becomes nested
Python closures; no template text is ever evaluated as code. The language:

* ``{{ expression }}`` inserts a value; ``{% for NAME in messages %} ... {% endfor %}``, ``{% if expression %} ...
  {% else %} ... {% endif %}`` and ``{% generation %} ... {% endgeneration %}`` nest freely; generation marks what the
  loss counts.
* Expressions are string literals, names, ``name.field`` with the fields role, text and index, ``+`` (joins strings),
  ``==``, ``!=``, ``and``, ``or``, ``not``, parentheses and the filters ``| escape``, ``| trim`` and ``| upper``.

Rendering is a generator over an iterator of messages: a conversation of any length streams through a task, which holds
one message at a time. ``escape`` puts a backslash before every backslash and before the first character of each control
string, so that control strings inside a text never read as markers and ``unescape`` restores the text.
Rows of a conversation are taken by turn, then role, then text; null turns come first, null texts and roles are empty.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: The template of the registered query, and the strings that mark its turns.
TEMPLATE = "{% for m in messages %}### {{ m.role | escape }}:\n{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}</turn>\n{% endfor %}"
CONTROLS = ("### ", "</turn>", ":\n")


class TemplateError(ValueError):
    """The template isn't one of the language."""


def escape(text: str, controls: tuple[str, ...] = CONTROLS) -> str:
    return re.sub("|".join([r"\\", *(f"(?={re.escape(c)})" for c in controls)]), lambda m: "\\\\" if m[0] else "\\", text)


def unescape(text: str) -> str:
    return re.sub(r"(?s)\\(.)", r"\1", text)


FILTERS: dict[str, Callable[[str], str]] = {"escape": escape, "trim": str.strip, "upper": str.upper}
FIELDS = ("role", "text", "index")
_TOKEN = re.compile(r"\s*(?:(?P<text>'[^']*'|\"[^\"]*\")|(?P<name>[A-Za-z_]\w*)|(?P<sign>==|!=|[+|().]))")


class _Expression:
    """Recursive descent over one expression; gives a tree of tuples."""

    def __init__(self, source: str):
        self.tokens, at, source = [], 0, source.strip()
        while at < len(source):
            if not (m := _TOKEN.match(source, at)):
                raise TemplateError(f"unexpected {source[at:]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0
        self.tree = self.either()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")

    def take(self, *values: str) -> str | None:
        if self.at < len(self.tokens) and self.tokens[self.at][1] in values and self.tokens[self.at][0] != "text":
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def _chain(self, below: Callable, *signs: str):
        tree = below()
        while sign := self.take(*signs):
            tree = (sign, tree, below())
        return tree

    def either(self):
        return self._chain(lambda: self._chain(self.negated, "and"), "or")

    def negated(self):
        return ("not", self.negated()) if self.take("not") else self._chain(self.joined, "==", "!=")

    def joined(self):
        return self._chain(self.filtered, "+")

    def filtered(self):
        tree = self.value()
        while self.take("|"):
            kind, name = self.tokens[self.at] if self.at < len(self.tokens) else ("", "")
            if name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            self.at += 1
            tree = ("filter", name, tree)
        return tree

    def value(self):
        if self.take("("):
            tree = self.either()
            if not self.take(")"):
                raise TemplateError("no closing parenthesis")
            return tree
        if self.at >= len(self.tokens):
            raise TemplateError("the expression ends early")
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind == "text":
            return ("constant", value[1:-1])
        if kind != "name" or value in ("and", "or", "not"):
            raise TemplateError(f"unexpected {value!r}")
        if self.take("."):
            field = self.tokens[self.at][1] if self.at < len(self.tokens) else ""
            if field not in FIELDS:
                raise TemplateError(f"no field {field!r}")
            self.at += 1
            return ("field", value, field)
        return ("name", value)


def parse(source: str) -> list:
    """The syntax tree: a list of ("text", s), ("value", e), ("for", name, body), ("if", e, body, other), ("generation", body)."""
    parts = re.split(r"(?s)(\{\{.*?\}\}|\{%.*?%\})", source)
    stack: list[tuple[str, list, list]] = [("", [], [])]
    for part in parts:
        body = stack[-1][1]
        if part.startswith("{{"):
            body.append(("value", _Expression(part[2:-2]).tree))
        elif not part.startswith("{%"):
            body += [("text", part)] if part else []
        else:
            word, _, rest = part[2:-2].strip().partition(" ")
            if word == "for":
                if not (m := re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+messages", rest.strip())):
                    raise TemplateError(f"only messages can be looped over: {rest!r}")
                stack.append((word, [], [m[1]]))
            elif word == "if":
                stack.append((word, [], [_Expression(rest).tree]))
            elif word == "generation":
                stack.append((word, [], []))
            elif word == "else" and stack[-1][0] == "if":
                head = stack.pop()
                stack.append(("else", [], [*head[2], head[1]]))
            elif word in ("endfor", "endif", "endgeneration") and stack[-1][0] in {"endfor": ("for",), "endif": ("if", "else"), "endgeneration": ("generation",)}[word]:
                kind, inner, head = stack.pop()
                node = {"for": ("for", *head, inner), "if": ("if", *head, inner, []), "else": ("if", *head, inner), "generation": ("generation", inner)}[kind]
                stack[-1][1].append(node)
            else:
                raise TemplateError(f"unexpected {part!r}")
    if len(stack) > 1:
        raise TemplateError(f"{stack[-1][0]} isn't closed")
    return stack[0][1]


def _apply(sign: str, a, b):
    if sign == "+":
        return str(a) + str(b)
    return a == b if sign == "==" else a != b if sign == "!=" else (a and b) if sign == "and" else (a or b)


def fold(tree):
    """The tree with constant expressions worked out, decided branches taken and neighbouring texts joined."""
    if isinstance(tree, list):
        out: list = []
        for node in tree:
            kind = node[0]
            if kind == "value":
                e = fold(node[1])
                node = ("text", str(e[1])) if e[0] == "constant" else ("value", e)
                new = [node]
            elif kind == "if":
                e, yes, no = fold(node[1]), fold(node[2]), fold(node[3])
                new = (yes if e[1] else no) if e[0] == "constant" else [("if", e, yes, no)]
            elif kind == "for":
                new = [("for", node[1], fold(node[2]))]
            elif kind == "generation":
                new = [("generation", fold(node[1]))]
            else:
                new = [node]
            for n in new:
                if n[0] == "text" and out and out[-1][0] == "text":
                    out[-1] = ("text", out[-1][1] + n[1])
                elif n != ("text", ""):
                    out.append(n)
        return out
    if tree[0] == "filter":
        inner = fold(tree[2])
        return ("constant", FILTERS[tree[1]](str(inner[1]))) if inner[0] == "constant" else ("filter", tree[1], inner)
    if tree[0] == "not":
        inner = fold(tree[1])
        return ("constant", not inner[1]) if inner[0] == "constant" else ("not", inner)
    if tree[0] in ("+", "==", "!=", "and", "or"):
        a, b = fold(tree[1]), fold(tree[2])
        return ("constant", _apply(tree[0], a[1], b[1])) if a[0] == b[0] == "constant" else (tree[0], a, b)
    return tree


def _expression(tree) -> Callable[[dict], object]:
    kind = tree[0]
    if kind == "constant":
        return lambda env, value=tree[1]: value
    if kind == "name":
        return lambda env, name=tree[1]: env.get(name, "")
    if kind == "field":
        return lambda env, name=tree[1], field=tree[2]: env[name][field] if name in env else ""
    if kind == "filter":
        return lambda env, f=FILTERS[tree[1]], inner=_expression(tree[2]): f(str(inner(env)))
    if kind == "not":
        return lambda env, inner=_expression(tree[1]): not inner(env)
    return lambda env, sign=kind, a=_expression(tree[1]), b=_expression(tree[2]): _apply(sign, a(env), b(env))


def _body(nodes: list) -> Callable[[dict, bool], Iterator[tuple[str, bool]]]:
    steps = [_node(n) for n in nodes]

    def run(env: dict, loss: bool) -> Iterator[tuple[str, bool]]:
        for step in steps:
            yield from step(env, loss)

    return run


def _node(node) -> Callable[[dict, bool], Iterator[tuple[str, bool]]]:
    if node[0] == "text":
        return lambda env, loss, piece=node[1]: iter(((piece, loss),))
    if node[0] == "value":
        return lambda env, loss, e=_expression(node[1]): iter(((str(e(env)), loss),))
    if node[0] == "generation":
        return lambda env, loss, inner=_body(node[1]): inner(env, True)
    if node[0] == "if":
        return lambda env, loss, e=_expression(node[1]), yes=_body(node[2]), no=_body(node[3]): (yes if e(env) else no)(env, loss)

    def loop(env: dict, loss: bool, name=node[1], inner=_body(node[2])) -> Iterator[tuple[str, bool]]:
        for message in env["messages"]:
            yield from inner(env | {name: message}, loss)

    return loop


def compile_template(source: str) -> Callable[[Iterator[dict]], Iterator[tuple[str, bool]]]:
    """A function from messages (role, text, index) to pieces of output and whether the loss counts them."""
    render = _body(fold(parse(source)))
    return lambda messages: render({"messages": messages}, False)


def _in_order(rows: DataFrame) -> DataFrame:
    """The rows of each conversation in one partition, one after the other. A long conversation streams; it is never held."""
    plain = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return plain.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def format_conversations(rows: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """(conv_id, part, piece, loss): the formatted conversations in pieces, in order within their partition.

    ``loss`` says that the training loss counts the piece. Joined by ``part``, the pieces are the formatted conversation.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template)
        rows_ = ((c, r, t) for b in batches for c, r, t in zip(*(b.column(n).to_pylist() for n in ("conv_id", "role", "text"))))
        out: list = []
        held = 0
        for conv, messages in groupby(rows_, key=lambda r: r[0]):
            told = ({"role": r, "text": t, "index": str(i)} for i, (_, r, t) in enumerate(messages))
            for part, (piece, loss) in enumerate(render(told)):
                out.append((conv, part, piece, loss))
                held += len(piece)
                if held > 1_000_000 or len(out) >= 20_000:
                    yield _batch(out)
                    out, held = [], 0
        if out:
            yield _batch(out)

    return _in_order(rows).mapInArrow(run, "conv_id long, part long, piece string, loss boolean")


def _batch(rows: list) -> pa.RecordBatch:
    names, kinds = ("conv_id", "part", "piece", "loss"), (pa.int64(), pa.int64(), pa.string(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], list(names))


_TURN = re.compile(r"(?s)### ((?:[^\\]|\\.)*?):\n((?:[^\\]|\\.)*?)</turn>\n")


class _Reader:
    """Reads the turns of one conversation back from its output, piece by piece."""

    def __init__(self):
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.formatted_chars = 0
        self.open = ""

    def add(self, piece: str, loss: bool) -> None:
        self.formatted_chars += len(piece)
        self.open += piece
        if loss:
            text = unescape(piece)
            self.loss_chars += len(text)
            self.loss.update(text.encode())
        if not piece.endswith("</turn>\n"):
            return
        at = 0
        for m in _TURN.finditer(self.open):
            if m.start() != at:
                break
            self.turns.update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode())
            self.n_turns, at = self.n_turns + 1, m.end()
        self.open = self.open[at:]

    def row(self, conv: int | None) -> tuple:
        if self.open:
            raise ValueError(f"conversation {conv} doesn't read back")
        return conv, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.formatted_chars


def read_back(pieces: DataFrame) -> DataFrame:
    """What the pieces of ``format_conversations`` say, read from the output alone: one row for each conversation."""
    names = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows_ = (r for b in batches for r in zip(*(b.column(n).to_pylist() for n in ("conv_id", "piece", "loss"))))
        done = []
        for conv, parts in groupby(rows_, key=lambda r: r[0]):
            reader = _Reader()
            for _, piece, loss in parts:
                reader.add(piece, loss)
            done.append(reader.row(conv))
            if len(done) >= 5_000:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in done], _DIGESTS)
                done = []
        if done:
            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in done], _DIGESTS)

    return pieces.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


_DIGESTS = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = r"\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    return read_back(format_conversations(given.unionByName(more)))


OP7_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
e AS (SELECT *, regexp_replace(regexp_replace(replace(text, '\', '\\'), '### |</turn>', '\\\0', 'g'), ':\n', '\\:' || chr(10), 'g') AS t,
        regexp_replace(regexp_replace(replace(role, '\', '\\'), '### |</turn>', '\\\0', 'g'), ':\n', '\\:' || chr(10), 'g') AS r FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('### ' || r || ':' || chr(10) || t || '</turn>' || chr(10))) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
