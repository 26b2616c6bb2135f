"""Chat formatting by schema fingerprints.

A record is a JSON text in any layout: a prompt with a completion, an instruction with input and output, a list of
messages, or one turn. Its nested field paths, without the kinds of the values, are hashed; the hash selects a
declarative mapping that says which paths make which turns. A layout with optional fields has a fingerprint for each
set of them. `format_turns` then writes turns into one string with control marks, escapes marks inside the texts
reversibly, and gives the spans that carry loss; `read_back` reads turns and loss texts out of that string again.

Cases: a record that isn't JSON, or whose fields fit no layout, has layout and turns null; null role and text are
empty; a conversation's turns go by turn (null first), then role, then text, so ties and repeated rows have one order;
an empty table gives an empty table. Other columns are left aside, whatever their names.
"""

from __future__ import annotations

import hashlib
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}

#: name, needed fields, optional fields, and the mapping: `turns` lists (role, paths whose texts are joined), `list` names
#: an array with the fields of role and text in each item, `row` takes one turn from two fields.
LAYOUTS = [
    {"name": "turn", "needs": ["role", "text"], "row": ("role", "text")},
    {"name": "turn_content", "needs": ["role", "content"], "row": ("role", "content")},
    {"name": "prompt", "needs": ["prompt", "completion"], "may": ["system"], "turns": [("system", ["system"]), ("user", ["prompt"]), ("assistant", ["completion"])]},
    {"name": "prompt_response", "needs": ["prompt", "response"], "may": ["system"], "turns": [("system", ["system"]), ("user", ["prompt"]), ("assistant", ["response"])]},
    {"name": "question", "needs": ["question", "answer"], "may": ["context"], "turns": [("user", ["context", "question"]), ("assistant", ["answer"])]},
    {"name": "instruction", "needs": ["instruction", "output"], "may": ["input", "system"], "turns": [("system", ["system"]), ("user", ["instruction", "input"]), ("assistant", ["output"])]},
    {"name": "messages", "needs": [("messages", ["role", "content"])], "may": ["id"], "list": ("messages", "role", "content")},
    {"name": "conversations", "needs": [("conversations", ["from", "value"])], "may": ["id"], "list": ("conversations", "from", "value")},
    {"name": "nested", "needs": [("data.messages", ["role", "content"])], "list": ("data.messages", "role", "content")},
]

_SCALAR = "STRING|BIGINT|DOUBLE|FLOAT|BOOLEAN|VOID|DATE|TIMESTAMP_NTZ|TIMESTAMP|BINARY|UUID|DECIMAL\\([0-9]+,[0-9]+\\)"


def _tree(fields: list) -> str:
    """Field paths in the form to which `paths` brings those of a record: names in order, kinds of plain values gone."""
    root: dict = {}
    for f in fields:
        path, items = (f, None) if isinstance(f, str) else f
        *above, last = path.split(".")
        at = root
        for name in above:
            at = at.setdefault(name, {})
        at[last] = items
    show = lambda x: f"OBJECT<{', '.join(k + (': ' + show(v) if isinstance(v, dict) else f': ARRAY<{show(dict.fromkeys(v))}>' if v else '') for k, v in sorted(x.items()))}>"
    return show(root)


def paths(record: Column) -> Column:
    """The nested field paths of a JSON text; null if it is none."""
    return _paths(F.try_parse_json(record))


def _paths(v: Column) -> Column:
    return F.regexp_replace(F.schema_of_variant(v), f": (?:{_SCALAR})(?=[,>])", "")


def fingerprint(record: Column) -> Column:
    return F.sha2(paths(record), 256)


def registry() -> dict[str, dict]:
    """Fingerprint to layout."""
    found = {}
    for layout in LAYOUTS:
        may = layout.get("may", [])
        for k in range(len(may) + 1):
            for more in combinations(may, k):
                found[hashlib.sha256(_tree([*layout["needs"], *more]).encode()).hexdigest()] = layout
    return found


def _role(role: Column) -> Column:
    out = role
    for said, meant in ROLES.items():
        out = F.when(role == said, F.lit(meant)).otherwise(out)
    return F.coalesce(out, F.lit(""))


def _turns(layout: dict, v: Column, fixed_roles: bool) -> Column:
    text = lambda x, path: F.coalesce(F.variant_get(x, f"$.{path}", "string"), F.lit(""))
    turn = lambda role, said: F.struct(role.alias("role"), said.alias("text"))
    if "row" in layout:
        role, said = layout["row"]
        return F.array(turn(text(v, role) if fixed_roles else _role(text(v, role)), text(v, said)))
    if "list" in layout:
        path, role, said = layout["list"]
        items = F.variant_get(v, f"$.{path}", "array<variant>")
        return F.coalesce(F.transform(items, lambda x: turn(text(x, role) if fixed_roles else _role(text(x, role)), text(x, said))), F.array().cast("array<struct<role:string,text:string>>"))
    turns = []
    for role, parts in layout["turns"]:
        present = [F.nullif(F.variant_get(v, f"$.{p}", "string"), F.lit("")) for p in parts]
        turns.append(turn(F.lit(role), F.array_join(F.array_compact(F.array(*present)), "\n\n")))
    return F.filter(F.array(*turns), lambda t: (t["role"] != "system") | (t["text"] != ""))


def canonical(df: DataFrame, record: str, fixed_roles: bool = False) -> DataFrame:
    """`row` (a struct of all columns of df, so that no name can clash), `fingerprint`, `layout` and `turns`, an array of (role, text).
    fixed_roles leaves the role names of turns and messages as they are."""
    rows = df.select(F.struct(*(df[c] for c in df.columns)).alias("row"), F.try_parse_json(df[record]).alias("v"))
    rows = rows.withColumn("fingerprint", F.sha2(_paths(F.col("v")), 256))
    by_name: dict[str, tuple[dict, list[str]]] = {}
    for print_, layout in registry().items():
        by_name.setdefault(layout["name"], (layout, []))[1].append(print_)
    name, turns = F.lit(None).cast("string"), F.lit(None).cast("array<struct<role:string,text:string>>")
    for layout, prints in by_name.values():
        hit = F.col("fingerprint").isin(prints)
        name, turns = F.when(hit, layout["name"]).otherwise(name), F.when(hit, _turns(layout, F.col("v"), fixed_roles)).otherwise(turns)
    return rows.select("row", "fingerprint", name.alias("layout"), turns.alias("turns"))


def escaped(text: Column) -> Column:
    """Text in which no control mark can begin: a backslash is doubled, and one put into `<|`."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\|])", "$1")


def format_turns(turns: DataFrame) -> DataFrame:
    """From rows (conv_id, turn, role, text), one row per conversation: `formatted`, and `loss`, the spans of assistant
    texts: number of the piece (from 0), where the piece begins, and begin and end of the text in `formatted`, all in
    code points."""
    role = F.replace(escaped(F.coalesce("role", F.lit(""))), F.lit("\n"), F.lit("<|nl|>"))
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.concat(F.lit(START), role, F.lit("\n")).alias("head"), escaped(F.coalesce("text", F.lit(""))).alias("body"))
    rows = rows.withColumn("size", (F.length("head") + F.length("body") + len(END)).cast("long"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = rows.withColumns({"n": F.row_number().over(order) - 1, "base": F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")})
    begin = F.col("base") + F.length("head")
    span = F.when(F.col("role") == "assistant", F.struct(F.col("n").alias("piece"), "base", begin.alias("start"), (begin + F.length("body")).alias("end")))
    rows = rows.select("conv_id", F.struct("n", F.concat("head", "body", F.lit(END)).alias("piece")).alias("p"), span.alias("s"))
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("p")).alias("p"), F.sort_array(F.collect_list("s")).alias("loss"))
    return grouped.select("conv_id", F.array_join(F.col("p.piece"), "").alias("formatted"), "loss")


def read_back(formatted: DataFrame) -> DataFrame:
    """`turns`, an array of (role, text), and `loss_texts`, from the formatted string and its loss spans alone."""
    pieces = formatted.withColumn("pieces", F.split("formatted", r"<\|im_end\|>\n"))

    def turn(p: Column) -> Column:
        said = F.substr(p, F.lit(len(START) + 1))
        role = F.substring_index(said, "\n", 1)
        return F.struct(unescaped(F.replace(role, F.lit("<|nl|>"), F.lit("\n"))).alias("role"), unescaped(F.substr(said, F.length(role) + 2)).alias("text"))

    under = lambda s: unescaped(F.substr(F.get("pieces", s["piece"]), (s["start"] - s["base"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))
    return pieces.withColumns({"turns": F.transform(F.slice("pieces", 1, F.size("pieces") - 1), turn), "loss_texts": F.transform("loss", under)}).drop("pieces")
