"""Chat formatting from event logs.

An event is (conv_id, seq, kind, turn, role, text), kind one of
  message     begins a message of its own, also where the turn has one
  delta       a piece of the message of that turn, the last one if there are several
  edit        replaces that turn's messages so far by one text; the first one's role stays
  regenerate  discards that turn's message and all later turns so far
Events are partitioned by conversation, sorted by sequence and folded into
final messages; messages are rendered in order and cut into parts of a bounded
number of messages, so a very long conversation is several rows.

Template: <|turn|>role, line feed, text, <|end|>, line feed. Inside roles and
texts a backslash is doubled and the < of any "<|" becomes backslash l (in
roles a line feed becomes backslash n), so no marker can arise there and
reading is exact. The loss mask covers the texts of assistant
turns (escaped, without markers).

Defined results: null text or role counts as empty; a null turn comes first;
events of equal seq are taken by turn, role, text and kind; an unknown kind is an
error; repeated rows are events of their own; an empty log has no output.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, END, BREAK = "<|turn|>", "<|end|>\n", "\n"
#: Messages of a conversation in one row of output.
PART_MESSAGES = 256
#: Characters of an event in the log made of plain rows.
EVENT_CHARS = 200


def escaped(text: Column) -> Column:
    """Backslashes doubled, the < of every <| replaced: no marker remains."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("\\l|"))


def unescape(text: str) -> str:
    if "\\" not in text:
        return text
    # halves of doubled backslashes come out as empty strings between the splits
    return "\\".join(part.replace("\\l|", "<|").replace("\\n", "\n") for part in text.split("\\\\"))


def log_of(rows: DataFrame) -> DataFrame:
    """Plain rows (conv_id, turn, role, text) as a log: a message with the first characters of a text, then deltas."""
    turn, text = F.col("turn").cast("long"), F.coalesce("text", F.lit(""))
    order = Window.partitionBy("conv_id").orderBy(turn, F.coalesce("role", F.lit("")), text)
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{EVENT_CHARS}}}"), F.lit(0))
    pieces = F.when(F.size(pieces) > 0, pieces).otherwise(F.array(F.lit("")))
    return (rows.select("conv_id", turn.alias("turn"), "role", F.row_number().over(order).cast("long").alias("n"), pieces.alias("p"))
            .select("*", F.posexplode("p").alias("i", "piece"))
            .select("conv_id", (F.shiftleft("n", 32) + F.col("i")).alias("seq"), F.when(F.col("i") == 0, "message").otherwise("delta").alias("kind"),
                    "turn", "role", F.col("piece").alias("text")))


def fold(events: DataFrame) -> DataFrame:
    """Final messages: conv_id, position (from 0), role, text."""
    known = F.col("kind").isin("message", "delta", "edit", "regenerate")
    kind = F.when(known, F.col("kind")).otherwise(F.raise_error(F.concat(F.lit("unknown kind of event: "), F.coalesce("kind", F.lit("null")))))
    rows = events.select("conv_id", "seq", kind.alias("kind"), F.coalesce("turn", F.lit(-(1 << 62))).alias("turn"),
                         F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    # a frame that only grows: one pass over the sorted partition, spilled where it is large
    later = Window.partitionBy("conv_id").orderBy(F.desc("seq"), F.desc("turn"), F.desc("role"), F.desc("text"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, -1)
    discarded = F.min(F.when(F.col("kind") == "regenerate", F.col("turn"))).over(later)
    alive = (rows.withColumn("_from", discarded).filter("kind != 'regenerate' AND (_from IS NULL OR turn < _from)").drop("_from"))
    events_of_turn = Window.partitionBy("conv_id", "turn").orderBy("seq", "role", "text", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    so_far = lambda kind: F.count(F.when(F.col("kind") == kind, 1)).over(events_of_turn)
    # messages between two edits; those before the last edit are replaced
    pieces = F.sort_array(F.collect_list(F.struct("seq", F.col("role").alias("own"), "text", "kind", "first")))
    own = F.when(F.col("p")[0]["kind"] == "edit", F.col("p")[0]["first"]).otherwise(F.col("p")[0]["own"])
    found = (alive.withColumns({"edits": so_far("edit"), "begun": so_far("message"), "first": F.first("role").over(events_of_turn)})
             .groupBy("conv_id", "turn", "edits", "begun").agg(pieces.alias("p"))
             .select("conv_id", "turn", "edits", "begun", own.alias("role"), F.array_join(F.transform("p", lambda x: x["text"]), "").alias("text")))
    final = found.withColumn("last", F.max("edits").over(Window.partitionBy("conv_id", "turn"))).filter("edits = last")
    order = Window.partitionBy("conv_id").orderBy("turn", "begun")
    return final.select("conv_id", (F.row_number().over(order) - 1).cast("long").alias("position"), "role", "text")


def render(messages: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """conv_id, part, formatted, loss (start and end in code points of this row's text, in order)."""
    head = F.concat(F.lit(TURN), F.replace(escaped(F.col("role")), F.lit("\n"), F.lit("\\n")), F.lit(BREAK))
    body = escaped(F.col("text"))
    rows = messages.select("conv_id", "position", F.floor(F.col("position") / PART_MESSAGES).alias("part"), F.concat(head, body, F.lit(END)).alias("s"),
                           F.char_length(head).cast("long").alias("h"), F.char_length(body).cast("long").alias("b"), (F.col("role") == loss_role).alias("m"))
    before = Window.partitionBy("conv_id", "part").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("at", F.coalesce(F.sum(F.char_length("s").cast("long")).over(before), F.lit(0)))
    span = F.when(F.col("m"), F.struct((F.col("at") + F.col("h")).alias("start"), (F.col("at") + F.col("h") + F.col("b")).alias("end")))
    return (placed.groupBy("conv_id", "part").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", "s"))), lambda x: x["s"]), "").alias("formatted"),
        F.sort_array(F.collect_list(span)).alias("loss")))


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted text: (role, text)."""
    out = []
    for piece in formatted.split(END)[:-1]:
        role, _, text = piece.removeprefix(TURN).partition(BREAK)
        out.append((unescape(role), unescape(text)))
    return out


def digests(rendered: DataFrame) -> DataFrame:
    """Read back: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Parts of a conversation arrive in order and only running digests are held, so its length does not matter.
    """
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, began = None, False
        turns = loss = None
        n = chars = total = 0

        def row() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            values = [now, n, turns.hexdigest(), chars, loss.hexdigest(), total]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)],
                                              ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
        for batch in batches:
            done = []
            for conv, formatted, spans in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss"))):
                if not began or conv != now:
                    if began:
                        done.append(row())
                    now, began, n, chars, total = conv, True, 0, 0, 0
                    turns, loss = hashlib.sha256(), hashlib.sha256()
                for role, text in parse(formatted):
                    n += 1
                    turns.update(f"{role}\n{text}\n".encode())
                for span in spans:
                    text = unescape(formatted[span["start"]:span["end"]])
                    chars += len(text)
                    loss.update(text.encode())
                total += len(formatted)
            if done:
                yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
        if began:
            yield row()
    return rendered.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(run, schema)
