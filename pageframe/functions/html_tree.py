"""HTML pages as a per-row element tree.

One Arrow UDF turns a page into `tree`, a struct of two arrays that never
leaves its row:

* ``nodes``: one struct per element in document order. ``node_id`` is the
  position in the array and ``end_id`` the position of the last descendant, so
  "B is inside A" is ``A.node_id < B.node_id <= A.end_id`` and a subtree is a
  slice of the array.
* ``strings``: the visible strings of the page in document order. A node holds
  the half-open range ``[s0, s1)`` of the strings below it, which keeps a tree
  linear in the size of its page however deep the nesting is.

What an extractor would have to search all nodes for is marked while the page
is read: whether an element is the last of its parent (``is_last``), lies in a
caption or a pagination, and which element of page chrome is the innermost one
around it, itself included (``chrome_id``, and ``string_chrome`` for strings).
``complete`` is false for a page whose end could not be read.

Everything after the parse is a Catalyst expression over that struct, so no
extractor needs a join or a shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Elements that never have content.
VOID_TAGS = frozenset(
    "area base br col embed hr img input keygen link menuitem meta param source track wbr "
    "basefont bgsound command frame image isindex nextid spacer".split()
)
# Elements whose strings are not part of the text around them.
HIDDEN_TEXT_TAGS = frozenset("script style template rt rp".split())
PREFORMATTED_TAGS = frozenset(("pre", "textarea"))
HTML_SPACES = " \n\t\f\r"
CLASS_SPACES = re.compile(r"[ \t\n\x0b\f\r]+")
# Navigation and the like around the content of a page.
CHROME_TAGS = frozenset(("nav", "header", "footer", "script", "style"))
CHROME_CLASSES = frozenset(("navbar", "nav", "header", "footer"))
# Tags in their plainest form, which most are, need none of the general parser's care.
PLAIN_START = re.compile(r'<([a-z][a-z0-9]*)((?: [a-z][a-z-]*="[^"&<>]*")*)>')
PLAIN_ATTRIBUTE = re.compile(r' ([a-z][a-z-]*)="([^"]*)"')
PLAIN_END = re.compile(r"</([a-z][a-z0-9]*)>")

NODE_DDL = (
    "struct<node_id:int,end_id:int,parent_id:int,depth:int,tag:string,"
    "attrs:map<string,string>,n_children:int,s0:int,s1:int,raw:string,"
    "is_last:boolean,in_caption:boolean,in_pagination:boolean,chrome_id:int>"
)
TREE_DDL = f"struct<nodes:array<{NODE_DDL}>,strings:array<string>,string_chrome:array<int>,complete:boolean>"

# What Python's str.strip() removes.
SPACE_CHARS = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())


# Fields of a row while a page is read.
TAG, ATTRS, PARENT, DEPTH, END, START, STOP, CHILDREN, RAW, CAPTION, PAGES, CHROME = range(12)


class _TreeReader(HTMLParser):
    """Collects the elements and visible strings of one page.

    No end tag is implied: an end tag closes everything up to the nearest open
    element of its name, and is ignored when there is none.
    """

    CDATA_CONTENT_ELEMENTS = ("script", "style")
    RCDATA_CONTENT_ELEMENTS = ()

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows = []
        self.strings = []
        self._open = []
        self._open_names = Counter()
        self._hidden = 0
        self._preformatted = 0
        self._pending = []
        self.string_chrome = []
        self.complete = True
        self._marked = Counter()  # open elements of the classes that matter
        self._last_child = {}

    def updatepos(self, i, j):
        # line numbers are not needed
        return j

    def parse_starttag(self, i):
        plain = PLAIN_START.match(self.rawdata, i)
        if plain is None:
            return super().parse_starttag(i)
        self.lasttag = tag = plain[1]
        self.handle_starttag(tag, PLAIN_ATTRIBUTE.findall(plain[2]))
        if tag in self.CDATA_CONTENT_ELEMENTS:
            self.set_cdata_mode(tag)
        return plain.end()

    def parse_endtag(self, i):
        plain = PLAIN_END.match(self.rawdata, i)
        if plain is None or self.cdata_elem is not None:
            return super().parse_endtag(i)
        self.handle_endtag(plain[1])
        return plain.end()

    def read(self, html):
        try:
            self.feed(html)
            self.close()
        except AssertionError:
            self.complete = False  # a malformed "<![" section; what stands before it is kept
        self._flush()
        while self._open:
            self._close_last()
        columns = zip(*self.rows) if self.rows else [()] * 12
        (self.tags, self.attrs, self.parents, self.depths, self.ends, self.starts, self.stops, self.children,
         self.raws, self.captions, self.paginations, self.chromes) = columns
        self.lasts = [self._last_child[parent] == node for node, parent in enumerate(self.parents)]
        return self

    def _flush(self):
        if not self._pending:
            return
        text = "".join(self._pending)
        self._pending = []
        if self._open:
            row = self.rows[self._open[-1]]
            row[CHILDREN] += 1
            if self._hidden:
                if row[TAG] in ("script", "style"):
                    row[RAW] = (row[RAW] or "") + text
                return
        if not self._preformatted and not text.strip(HTML_SPACES):
            text = "\n" if "\n" in text else " "
        self.strings.append(text)
        self.string_chrome.append(self.rows[self._open[-1]][CHROME] if self._open else -1)

    def _close_last(self):
        row = self.rows[self._open.pop()]
        tag = row[TAG]
        self._open_names[tag] -= 1
        if tag in HIDDEN_TEXT_TAGS:
            self._hidden -= 1
        elif tag in PREFORMATTED_TAGS:
            self._preformatted -= 1
        for name in ("caption", "pagination"):
            if name in row[ATTRS].get("class", "") and name in CLASS_SPACES.split(row[ATTRS]["class"]):
                self._marked[name] -= 1
        row[END] = len(self.rows) - 1
        row[STOP] = len(self.strings)

    def _open_element(self, tag, attrs):
        self._flush()
        parent = -1
        if self._open:
            parent = self._open[-1]
            self.rows[parent][CHILDREN] += 1
        values = {name: value or "" for name, value in attrs}
        at = len(self.strings)
        node = len(self.rows)
        classes = CLASS_SPACES.split(values["class"]) if "class" in values else ()
        if tag in CHROME_TAGS or not CHROME_CLASSES.isdisjoint(classes):
            chrome = node
        else:
            chrome = self.rows[parent][CHROME] if parent >= 0 else -1
        marked = self._marked
        self.rows.append(
            [tag, values, parent, len(self._open), node, at, at, 0, None, marked["caption"] > 0, marked["pagination"] > 0, chrome]
        )
        for name in ("caption", "pagination"):
            if name in classes:
                marked[name] += 1
        self._last_child[parent] = node
        self._open.append(node)
        self._open_names[tag] += 1
        if tag in HIDDEN_TEXT_TAGS:
            self._hidden += 1
        elif tag in PREFORMATTED_TAGS:
            self._preformatted += 1

    def handle_starttag(self, tag, attrs):
        self._open_element(tag, attrs)
        if tag in VOID_TAGS:
            self._close_last()

    def handle_startendtag(self, tag, attrs):
        self._open_element(tag, attrs)
        self._close_last()

    def handle_endtag(self, tag):
        self._flush()
        if self._open_names[tag]:
            while self.rows[self._open[-1]][TAG] != tag:
                self._close_last()
            self._close_last()

    def handle_data(self, data):
        self._pending.append(data)

    def handle_comment(self, data):
        self._flush()
        if self._open:
            self.rows[self._open[-1]][CHILDREN] += 1

    def handle_pi(self, data):
        self.handle_comment(data)

    def handle_decl(self, decl):
        self.handle_comment(decl)

    def unknown_decl(self, data):
        if data.startswith("CDATA["):
            self._flush()
            self._pending.append(data[len("CDATA["):])
            self._flush()
        else:
            self.handle_comment(data)


def _read_trees(html: pa.Array) -> pa.Array:
    ints = {name: [] for name in ("node_id", "end_id", "parent_id", "depth", "n_children", "s0", "s1", "chrome_id")}
    flags = {name: [] for name in ("is_last", "in_caption", "in_pagination")}
    string_chrome, complete = [], []
    tags, raws, strings = [], [], []
    attr_names, attr_values, attr_offsets = [], [], [0]
    node_offsets, string_offsets = [0], [0]
    for page in html:
        page = page.as_py()
        if page:
            reader = _TreeReader().read(page)
            ints["node_id"].extend(range(len(reader.tags)))
            ints["end_id"].extend(reader.ends)
            ints["parent_id"].extend(reader.parents)
            ints["depth"].extend(reader.depths)
            ints["n_children"].extend(reader.children)
            ints["s0"].extend(reader.starts)
            ints["s1"].extend(reader.stops)
            ints["chrome_id"].extend(reader.chromes)
            flags["is_last"].extend(reader.lasts)
            flags["in_caption"].extend(reader.captions)
            flags["in_pagination"].extend(reader.paginations)
            string_chrome.extend(reader.string_chrome)
            tags.extend(reader.tags)
            raws.extend(reader.raws)
            for attrs in reader.attrs:
                attr_names.extend(attrs)
                attr_values.extend(attrs.values())
                attr_offsets.append(len(attr_names))
            strings.extend(reader.strings)
        complete.append(not page or reader.complete)
        node_offsets.append(len(tags))
        string_offsets.append(len(strings))

    columns = {name: pa.array(values, pa.int32()) for name, values in ints.items()}
    columns["tag"] = pa.array(tags, pa.string())
    columns["attrs"] = pa.MapArray.from_arrays(
        pa.array(attr_offsets, pa.int32()), pa.array(attr_names, pa.string()), pa.array(attr_values, pa.string())
    )
    columns["raw"] = pa.array(raws, pa.string())
    columns |= {name: pa.array(values, pa.bool_()) for name, values in flags.items()}
    order = ["node_id", "end_id", "parent_id", "depth", "tag", "attrs", "n_children", "s0", "s1", "raw"]
    order += ["is_last", "in_caption", "in_pagination", "chrome_id"]
    nodes = pa.ListArray.from_arrays(
        pa.array(node_offsets, pa.int32()), pa.StructArray.from_arrays([columns[n] for n in order], order)
    )
    texts = pa.ListArray.from_arrays(pa.array(string_offsets, pa.int32()), pa.array(strings, pa.string()))
    chromes = pa.ListArray.from_arrays(pa.array(string_offsets, pa.int32()), pa.array(string_chrome, pa.int32()))
    return pa.StructArray.from_arrays(
        [nodes, texts, chromes, pa.array(complete, pa.bool_())], ["nodes", "strings", "string_chrome", "complete"]
    )


#: A tree takes some tens of times the bytes of its page while it is read, so a batch of pages is read in parts.
PART_BYTES = 1 << 20


def parts_of(batch: pa.Array, max_bytes: int = PART_BYTES) -> Iterator[pa.Array]:
    """Cuts a batch of texts at about every `max_bytes`; a longer text is a part of its own."""
    start, held = 0, 0
    for at, size in enumerate(pc.fill_null(pc.binary_length(batch), 0).to_pylist()):
        if at > start and held + size > max_bytes:
            yield batch.slice(start, at - start)
            start, held = at, 0
        held += size
    yield batch.slice(start)


def _read_parts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        for part in parts_of(batch):
            yield _read_trees(part)


def parse_tree(html: Column | str) -> Column:
    return F.arrow_udf(_read_parts, TREE_DDL)(html)


# --- column helpers over a tree -------------------------------------------------


def strip(text: Column) -> Column:
    """Trim every character Python calls white space."""
    return F.btrim(text, F.lit(SPACE_CHARS))


def attr(node: Column, name: str) -> Column:
    return node["attrs"].getItem(name)


def has_attr(node: Column, name: str) -> Column:
    return attr(node, name).isNotNull()


def has_class(node: Column, name: str) -> Column:
    return F.array_contains(F.split(attr(node, "class"), r"\s+"), name)


def attr_contains(node: Column, name: str, part: str) -> Column:
    return attr(node, name).contains(part)


def is_tag(node: Column, *tags: str) -> Column:
    return node["tag"] == tags[0] if len(tags) == 1 else node["tag"].isin(*tags)


def inside(node: Column, outer: Column) -> Column:
    return (node["node_id"] > outer["node_id"]) & (node["node_id"] <= outer["end_id"])


def subtree(tree: Column, node: Column) -> Column:
    """The descendants of `node`, in document order."""
    return F.slice(tree["nodes"], node["node_id"] + 2, node["end_id"] - node["node_id"])


def text_of(tree: Column, node: Column, strings: Column | None = None) -> Column:
    strings = tree["strings"] if strings is None else strings
    return F.array_join(F.slice(strings, node["s0"] + 1, node["s1"] - node["s0"]), "")


def first(items: Column) -> Column:
    return F.get(items, F.lit(0))


def let(value: Column, body) -> Column:
    """`body(value)` with `value` computed once, however often the body uses it."""
    return first(F.transform(F.array(value), body))


def find_all(nodes: Column, matches) -> Column:
    return F.filter(nodes, matches)


def find_first(nodes: Column, matches) -> Column:
    return first(F.filter(nodes, matches))


def explode_rows(df: DataFrame, keep: list, items: Column, name: str, position: str | None = None) -> DataFrame:
    """One row per element of `items`, as `name`, beside the columns in `keep`.

    A plain explode makes the optimizer repeat `items` in a filter on its size,
    which would run a parse twice. The outer form does not, and the row it makes
    of an empty array is dropped afterwards.
    """
    if position is None:
        return df.select(*keep, F.explode_outer(items).alias(name)).filter(F.col(name).isNotNull())
    return df.select(*keep, F.posexplode_outer(items).alias(position, name)).filter(F.col(position).isNotNull())
