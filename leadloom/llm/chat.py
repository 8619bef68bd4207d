"""Chat formatting by incremental rendering of a template that is a black box.

For each conversation the template renders the first turn, the first two, and so on.
Where a rendering extends the one before, the new characters are the turn's span; where
it doesn't, the template has rewritten history and nothing of it may be trained on.

Inside a span, the turn's text is found by comparing renderings as well: the same prefix
is rendered with two probe texts in the turn's place, and what both have in common
before and after the probes are the marks that the template puts around any text there.
Roles are read back the same way, by probe roles, or, from a template with names of its
own for roles, by looking up the marks of the conversation's roles.

A conversation of n turns takes 3 n renderings; each is read once, so the work is n
times the length of the rendering.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]

#: Control strings of the bundled template are made of these characters; texts and roles have them escaped.
_ESCAPES = {"\\": "\\b", "<": "\\a", "[": "\\o", "]": "\\c"}
_BACK = {v: k for k, v in _ESCAPES.items()}
_SPECIAL = re.compile(r"[\\<\[\]]")
_ESCAPED = re.compile(r"\\[baoc]")
#: Texts and roles that stand in for others: letters that no template needs to escape.
_PROBES = ("q", "z")
_CACHE_CHARS = 32_000_000


def escape(text: str) -> str:
    """Texts in which no control string can occur; ``unescape`` gives them back."""
    return _SPECIAL.sub(lambda m: _ESCAPES[m[0]], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: _BACK[m[0]], text)


class BracketTemplate:
    """Each turn as ``[INST:role] text [/INST]``, assistant turns ended by ``</s>``.

    Escaped turns are kept for the next, longer prefix.
    """

    def __init__(self):
        self.made: dict[Turn, str] = {}
        self.size = 0

    def __reduce__(self):
        return (BracketTemplate, ())

    def _turn(self, turn: Turn) -> str:
        made = self.made.get(turn)
        if made is None:
            role, text = turn
            made = f"[INST:{escape(role)}] {escape(text)} [/INST]" + ("</s>" if role == "assistant" else "")
            if self.size > _CACHE_CHARS:
                self.made.clear()
                self.size = 0
            self.made[turn] = made
            self.size += len(made)
        return made

    def __call__(self, turns: list[Turn]) -> str:
        return "".join(map(self._turn, turns))


bracket_template = BracketTemplate()


def locate(turns: list[Turn], template: Template) -> tuple[str, list[tuple[int, int]], bool]:
    """The rendering of all turns, each turn's span in it, and whether history was rewritten.

    A rewriting template's span of a turn begins after the longest common beginning of
    two successive renderings and may overlap; callers must not train on such spans.
    """
    rendered, spans, rewritten = "", [], False
    for n in range(1, len(turns) + 1):
        longer = template(turns[:n])
        if longer.startswith(rendered):
            start = len(rendered)
        else:
            rewritten = True
            start = _common(rendered, longer)
        spans.append((start, len(longer)))
        rendered = longer
    return rendered, spans, rewritten


def _common(a: str, b: str) -> int:
    low, high = 0, min(len(a), len(b))
    while low < high:  # slices are compared faster than characters
        middle = (low + high + 1) // 2
        if a.startswith(b[low:middle], low):
            low = middle
        else:
            high = middle - 1
    return low


def marks(before: list[Turn], role: str, template: Template, known: int = 0) -> tuple[str, str] | None:
    """What the template puts before and after any text of ``role`` after the turns ``before``.

    ``known`` characters of the rendering are those of ``before`` and not part of the
    marks.  None if the probes don't show up once each, or the template refuses the role.
    """
    try:
        a, b = (template([*before, (role, p)])[known:] for p in _PROBES)
    except Exception:  # noqa: BLE001  (a template may reject roles in any way it likes)
        return None
    head = _common(a, b)
    tail = _common(a[head:][::-1], b[head:][::-1])
    if a[head : len(a) - tail] != _PROBES[0] or b[head : len(b) - tail] != _PROBES[1]:
        return None
    return a[:head], a[len(a) - tail :]


class Reader:
    """Roles and texts of turns, from spans of a rendering and the template alone."""

    def __init__(self, template: Template, roles: list[str], back: Callable[[str], str]):
        self.template, self.roles, self.back = template, list(dict.fromkeys(roles)), back
        self.found: dict[str, str | None] = {}

    def role(self, before: list[Turn], known: int, head: str) -> str | None:
        """The role that a turn's first mark shows; None if it shows none, or none alone."""
        if head not in self.found:
            self.found[head] = self._probed(before, known, head) or self._looked_up(before, known, head)
        return self.found[head]

    def _probed(self, before: list[Turn], known: int, head: str) -> str | None:
        shown = [marks(before, p, self.template, known) for p in _PROBES]
        if None in shown:
            return None
        a, b = shown[0][0], shown[1][0]
        start = _common(a, b)
        end = _common(a[start:][::-1], b[start:][::-1])
        lead, close = a[:start], a[len(a) - end :] if end else ""
        if a == b or not head.startswith(lead) or not head.endswith(close) or len(head) < len(lead) + len(close):
            return None
        return self.back(head[len(lead) : len(head) - len(close)])

    def _looked_up(self, before: list[Turn], known: int, head: str) -> str | None:
        fit = [r for r in self.roles if (marks(before, r, self.template, known) or ("", ""))[0] == head]
        return fit[0] if len(fit) == 1 else None


def format_conversation(turns: list[Turn], template: Template = bracket_template, loss_roles: tuple[str, ...] = ("assistant",)) -> dict:
    """The formatted text, turn spans, text spans and the loss mask's spans.

    ``text_spans`` has None for a turn whose text the template doesn't render as it
    renders probes.  The loss mask has the texts of ``loss_roles``, without marks; of a
    template that rewrote history it has nothing, and no text is located.
    """
    text, spans, rewritten = locate(turns, template)
    places: list[tuple[int, int] | None] = []
    around: list[tuple[str, str] | None] = []
    for n, (start, end) in enumerate(spans):
        found = None if rewritten else marks(turns[:n], turns[n][0], template, start)
        fits = found is not None and end - start >= len(found[0]) + len(found[1]) and text.startswith(found[0], start) and text.startswith(found[1], end - len(found[1]))
        around.append(found if fits else None)
        places.append((start + len(found[0]), end - len(found[1])) if fits else None)
    masks = [p for p, (role, _) in zip(places, turns) if p is not None and role in loss_roles]
    return {"formatted": text, "spans": spans, "text_spans": places, "marks": around, "loss_spans": masks, "rewritten": rewritten}


def digests(made: dict, turns: list[Turn], template: Template = bracket_template, back: Callable[[str], str] = unescape) -> dict:
    """What a reader gets back from the formatted text, its spans and the template.

    ``turns`` serves to render prefixes for probes only; roles and texts come from the
    formatted text.  turns_sha256 is null where a role or a text can't be read back,
    loss_sha256 where history was rewritten.
    """
    text = made["formatted"]
    reader = Reader(template, [r for r, _ in turns], back)
    read, loss = hashlib.sha256(), hashlib.sha256()
    whole = not made["rewritten"]
    for n, (place, around) in enumerate(zip(made["text_spans"], made["marks"])):
        role = reader.role(turns[:n], made["spans"][n][0], around[0]) if place and whole else None
        whole = whole and role is not None
        if whole:
            read.update(f"{role}\n{back(text[place[0] : place[1]])}\n".encode("utf-8", "surrogatepass"))
    chars = 0
    for a, b in made["loss_spans"]:
        part = back(text[a:b])
        chars += len(part)
        loss.update(part.encode("utf-8", "surrogatepass"))
    return {
        "n_turns": len(made["spans"]),
        "turns_sha256": read.hexdigest() if whole else None,
        "loss_chars": chars,
        "loss_sha256": None if made["rewritten"] else loss.hexdigest(),
        "formatted_chars": len(text),
    }


SCHEMA = (
    "conv_id long, formatted string, spans array<struct<start:long,end:long>>, loss_spans array<struct<start:long,end:long>>, rewritten boolean, "
    "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
)


def format_conversations(
    turns: DataFrame, template: Template = bracket_template, back: Callable[[str], str] = unescape, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """One row per conversation: its formatted text, spans, loss spans and digests.

    Rows of a conversation are ordered by turn, then role, then text, so repeated turn
    numbers have a defined order.  Null roles and texts are empty; null turns come first;
    rows of a null conversation id are one conversation.  Other columns are not read.  A
    partition is sorted and streamed; a task holds one conversation at a time.  ``back``
    undoes the template's escapes (the identity for a template without any).  See
    :func:`digests` for templates that rewrite history or can't be read back.
    """
    rows = turns.select(
        F.col(id_col).cast("long").alias("conv_id"),
        F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    # Salted by nothing: a conversation is one sample and goes to one task by definition.
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    fields = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    names = [f.split()[0] for f in ("conv_id formatted spans loss_spans rewritten n_turns turns_sha256 loss_chars loss_sha256 formatted_chars").split()]

    def finished(held: list[tuple[int | None, list[Turn]]]) -> pa.RecordBatch:
        made = [format_conversation(t, template) for _, t in held]
        read = [digests(m, t, template, back) for m, (_, t) in zip(made, held)]
        pairs = lambda k: pa.array([[{"start": a, "end": b} for a, b in m[k]] for m in made], pa.list_(fields))
        return pa.RecordBatch.from_arrays(
            [
                pa.array([c for c, _ in held], pa.int64()), pa.array([m["formatted"] for m in made], pa.string()), pairs("spans"), pairs("loss_spans"), pa.array([m["rewritten"] for m in made], pa.bool_()),
                *[pa.array([r[k] for r in read], pa.string() if "sha" in k else pa.int64()) for k in names[5:]],
            ],
            names=names,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: int | None = None
        own: list[Turn] = []
        held: list[tuple[int | None, list[Turn]]] = []
        size = 0
        for batch in batches:
            for conv, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if own and conv != current:
                    held.append((current, own))
                    own = []
                    if size > 4_000_000:
                        yield finished(held)
                        held, size = [], 0
                current = conv
                own.append((role, text))
                size += len(text)
        if own:
            held.append((current, own))
        if held:
            yield finished(held)

    return dealt.mapInArrow(run, SCHEMA)
