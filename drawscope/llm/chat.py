"""Chat formatting with a grammar round trip, in DataFrame functions only.

A turn is rendered between marks that depend on its role::

    <<SYS>>text<</SYS>>   [INST]text[/INST]   <s>text</s>   [ROLE]role[TEXT]text[/ROLE]

(system, user, assistant, any other role). A conversation is first rendered as it is, parsed
again with a deterministic grammar (an opening mark, then everything up to the first closing
mark of the same kind), unescaped and compared with its source turns. Where they differ,
some turns conflict: rendered by themselves, they don't parse back. Those turns, and no others, are escaped: the first character of a control
string is followed by one more backslash than before (``</s>`` becomes ``<\\/s>``, ``<\\/s>``
becomes ``<\\\\/s>``). Unescaping takes one backslash away, so the pair is exactly reversible,
and a rendered control string is always a real mark. The new rendering is parsed and compared
again; should it still differ, all turns are escaped, and a difference after that stops the job.

The loss mask is the list of code-point ranges [lo, hi) of assistant texts in the rendering.
Places are running sums over blocks of ``RUN`` turns, and texts are cut from their turn's own
piece, so the work grows in proportion to a conversation's length and number of turns.

Defined cases: null texts and roles are empty; turns are ordered by number, role and text,
nulls first, and repeated rows are repeated turns; a row with a null conversation id is a
conversation of its own (nothing says which rows belong together); an empty table gives no
conversations; further columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN = {"system": "<<SYS>>", "user": "[INST]", "assistant": "<s>"}
CLOSE = {"system": "<</SYS>>", "user": "[/INST]", "assistant": "</s>"}
OTHER = ("[ROLE]", "[TEXT]", "[/ROLE]")

#: What follows the first character, and any backslashes, of a control string.
_REST = r"(/?INST\]|/?ROLE\]|TEXT\]|/?s>|</?SYS>>)"
ESCAPE = (r"([\[<])(\\*)" + _REST, r"$1\\$2$3")
UNESCAPE = (r"([\[<])\\(\\*)" + _REST, r"$1$2$3")
RUN = 256
TURN = r"(?s)\[INST\].*?\[/INST\]|<s>.*?</s>|<<SYS>>.*?<</SYS>>|\[ROLE\].*?\[/ROLE\]"


def let(value: Column, body) -> Column:
    """``body(value)``, with ``value`` computed once however often, and in whatever lambda, body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def escape(text: Column) -> Column:
    return F.regexp_replace(text, *map(F.lit, ESCAPE))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, *map(F.lit, UNESCAPE))


def _by_role(role: Column, of: dict[str, str], other: Column) -> Column:
    out = None
    for name, value in of.items():
        out = F.when(role == name, F.lit(value)) if out is None else out.when(role == name, F.lit(value))
    return out.otherwise(other)


def _rendered(turn: Column, escaped: bool) -> Column:
    put = escape if escaped else (lambda x: x)
    role, text = turn["role"], turn["text"]
    return F.concat(_by_role(role, OPEN, F.concat(F.lit(OTHER[0]), put(role), F.lit(OTHER[1]))), put(text), _by_role(role, CLOSE, F.lit(OTHER[2])))


def conflicts(turn: Column) -> Column:
    """Whether a turn, rendered as it is, does not parse back to itself."""
    parsed_back = lambda p: let(pieces(p), lambda found: (F.size(found) == 1) & (F.get(found, F.lit(0)) == p)) & (_turn(p) == turn)
    return ~let(_rendered(turn, False), parsed_back)


def render(turns: Column, escaped: bool | str) -> Column:
    """``turns``: an array of structs with role and text. escaped: no turn (False), all (True), or those that conflict."""
    one = (lambda t: F.when(conflicts(t), _rendered(t, True)).otherwise(_rendered(t, False))) if escaped == "conflicts" else (lambda t: _rendered(t, bool(escaped)))
    return F.array_join(F.transform(turns, one), "")


def pieces(formatted: Column) -> Column:
    """The rendered turns, marks included."""
    return F.regexp_extract_all(formatted, F.lit(TURN), F.lit(0))


def _opened(piece: Column) -> Column:
    """Length of the opening mark (with the role, for other roles)."""
    out = None
    for mark in OPEN.values():
        out = F.when(F.startswith(piece, F.lit(mark)), F.lit(len(mark))) if out is None else out.when(F.startswith(piece, F.lit(mark)), F.lit(len(mark)))
    return out.otherwise(F.locate(OTHER[1], piece) + len(OTHER[1]) - 1)


def _closed(piece: Column) -> Column:
    out = None
    for role, mark in OPEN.items():
        here = F.startswith(piece, F.lit(mark))
        out = F.when(here, F.lit(len(CLOSE[role]))) if out is None else out.when(here, F.lit(len(CLOSE[role])))
    return out.otherwise(F.lit(len(OTHER[2])))


def _turn(piece: Column) -> Column:
    role = None
    for name, mark in OPEN.items():
        here = F.startswith(piece, F.lit(mark))
        role = F.when(here, F.lit(name)) if role is None else role.when(here, F.lit(name))
    other = unescape(F.substring(piece, F.lit(len(OTHER[0]) + 1), _opened(piece) - len(OTHER[0]) - len(OTHER[1])))
    text = unescape(F.substring(piece, _opened(piece) + 1, F.length(piece) - _opened(piece) - _closed(piece)))
    return F.struct(role.otherwise(other).alias("role"), text.alias("text"))


def parse(formatted: Column) -> Column:
    """The turns of a rendering: an array of structs of role and text, unescaped."""
    return F.transform(pieces(formatted), _turn)


def _places(lengths: Column) -> Column:
    """Where each piece begins, from the pieces' lengths: running sums within blocks, and over them."""
    zero = F.lit(0).cast("long")
    none = F.array().cast("array<bigint>")

    def running(values: Column) -> Column:
        start = F.struct(zero.alias("at"), none.alias("out"))
        return F.aggregate(values, start, lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))["out"]

    def placed(block: Column) -> Column:
        before = running(F.transform(block, lambda x: F.aggregate(x, zero, lambda n, y: n + y)))
        both = F.arrays_zip(F.transform(block, running).alias("w"), before.alias("b"))
        return F.flatten(F.transform(both, lambda z: F.transform(z["w"], lambda x: x + z["b"])))

    def blocks(all_: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / RUN).cast("int")), lambda b: F.slice(all_, b * RUN + 1, RUN))

    return let(lengths, lambda all_: F.when(F.size(all_) == 0, none).otherwise(let(blocks(all_), placed)))


def _of_assistant(formatted: Column) -> Column:
    """(at, piece) of the assistant's turns."""
    placed = lambda found: F.arrays_zip(_places(F.transform(found, lambda p: F.length(p).cast("long"))).alias("at"), found.alias("piece"))
    return F.filter(let(pieces(formatted), placed), lambda x: F.startswith(x["piece"], F.lit(OPEN["assistant"])))


def loss_mask(formatted: Column) -> Column:
    """Ranges [lo, hi) of the assistant's texts, in code points."""
    span = lambda x: F.struct((x["at"] + len(OPEN["assistant"])).alias("lo"), (x["at"] + F.length(x["piece"]) - len(CLOSE["assistant"])).alias("hi"))
    return F.transform(_of_assistant(formatted), span)


def masked_text(formatted: Column, spans: Column) -> Column:
    """The text under the loss mask, unescaped. Each span is cut from the piece that holds it."""
    both = F.arrays_zip(_of_assistant(formatted).alias("p"), spans.alias("s"))
    cut = lambda x: unescape(F.substring(x["p"]["piece"], (x["s"]["lo"] - x["p"]["at"] + 1).cast("int"), (x["s"]["hi"] - x["s"]["lo"]).cast("int")))
    return F.array_join(F.transform(both, cut), "")


def format_chats(rows: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, formatted, loss): a row for each conversation."""
    turns = rows.select(F.col(conversation).alias("conv_id"), F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).alias("t"))
    known = turns.where("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    grouped = known.unionByName(turns.where("conv_id is null").select("conv_id", F.array("t").alias("turns"))).select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))

    def same(formatted: Column) -> Column:
        return let(pieces(formatted), lambda found: (F.array_join(found, "") == formatted) & (F.transform(found, _turn) == F.col("turns")))

    tried = grouped.withColumn("formatted", render(F.col("turns"), False))
    for escaped in ("conflicts", True):
        tried = tried.withColumn("formatted", F.when(same(F.col("formatted")), F.col("formatted")).otherwise(render(F.col("turns"), escaped)))
    sure = F.when(same(F.col("formatted")), F.col("formatted")).otherwise(F.raise_error(F.lit("a rendering does not parse back to its turns")))
    return tried.select("conv_id", sure.alias("formatted")).select("conv_id", "formatted", loss_mask(F.col("formatted")).alias("loss"))
