"""HTML to text and HTML to a node table.

``plain_text``/``spaced_text`` strip markup with JVM expressions only.
``html_nodes`` is the one place that needs Python: a tokenizer turns a page into
an array of node structs. Selecting, cascading and joining text on those nodes
is done with DataFrame expressions.
"""

from __future__ import annotations

import html.entities
import json
import re
from functools import reduce
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postmill.functions.text import SEP, clip, collapse, first_where, let, strip

_MARKUP = (
    r"(?is)<!--.*?-->"
    r"|<(script|style)\b[^>]*>.*?</\1\s*>"
    r"|<[!?][^>]*>"
    r"""|</?[a-z](?:[^>"']++|"[^"]*"|'[^']*')*+>"""
)


def entity_table() -> dict[str, str]:
    """Name to text, from the standard library; numbers 128-159 read as Windows text."""
    table = {name.rstrip(";"): text for name, text in html.entities.html5.items()}
    for code in range(128, 160):
        try:
            table[f"#{code}"] = bytes([code]).decode("cp1252")
        except UnicodeDecodeError:
            table[f"#{code}"] = chr(code)
    return table


# Maps over which the names of the table are spread; a power of two above half their number.
ENTITY_SLOTS = 1024


def _entity_maps() -> list[dict[str, str]]:
    """The table as small maps, a name in the map of its slot (see ``_named_entity``)."""
    maps: list[dict[str, str]] = [{} for _ in range(ENTITY_SLOTS)]
    for name, put in entity_table().items():
        first, second, third = (ord(ch) for ch in name[:3].ljust(3, "\0"))
        last = ord(name[-1])
        maps[(first + 7 * second + 61 * third + 151 * last + 401 * len(name)) % ENTITY_SLOTS][name] = put
    return maps


def _named_entity(name: Column) -> Column:
    """Text of a reference by its name, else null. Spark searches a map entry by entry, so the map is picked by place first."""
    first, second, third = (F.ascii(F.substring(name, i, 1)) for i in (1, 2, 3))
    last = F.ascii(F.right(name, F.lit(1)))
    slot = (first + second * 7 + third * 61 + last * 151 + F.length(name) * 401) % ENTITY_SLOTS
    maps = F.from_json(F.lit(json.dumps(_entity_maps())), "array<map<string,string>>")
    return F.try_element_at(F.get(maps, slot), name)


def decode_entities(c: Column) -> Column:
    """Replace character references; an unknown name stays, without its semicolon."""

    def code_point(ref: Column) -> Column:
        hexa = ref.rlike("^#[xX]")
        code = F.when(hexa, F.conv(F.substring(ref, 3, 12), 16, 10)).otherwise(F.substring(ref, 2, 12))
        number = code.try_cast("bigint")
        valid = number.between(1, 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
        utf32 = F.unhex(F.lpad(F.hex(number), 8, "0"))
        from_table = F.when(number < 256, _named_entity(F.concat(F.lit("#"), number.cast("string"))))
        return F.coalesce(from_table, F.when(valid, F.decode(utf32, "UTF-32")), F.lit("�"))

    def piece(p: Column) -> Column:
        def put(ref: Column) -> Column:
            rest = F.regexp_replace(F.substr(p, F.length(ref) + 1), "^;", "")
            named = F.coalesce(_named_entity(ref), F.concat(F.lit("&"), ref))
            return F.concat(F.when(ref.startswith("#"), code_point(ref)).otherwise(named), rest)

        ref = F.regexp_extract(p, r"^(#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*)", 1)
        return F.when(p.rlike(r"^(#[0-9]|#[xX][0-9a-fA-F]|[A-Za-z])"), let(ref, put)).otherwise(
            F.concat(F.lit("&"), p)
        )

    def rebuild(parts: Column) -> Column:
        decoded = F.transform(F.slice(parts, F.lit(2), F.size(parts)), piece)
        return F.concat(parts.getItem(0), F.array_join(decoded, ""))

    return let(c, lambda t: F.when(t.contains("&"), let(F.split(t, "&"), rebuild)).otherwise(t))


def _without_markup(c: Column, mark: str) -> Column:
    return let(c, lambda t: F.when(t.contains("<"), F.regexp_replace(t, _MARKUP, mark)).otherwise(t))


def plain_text(html_text: Column) -> Column:
    """Text content with nothing put between the pieces."""
    return decode_entities(_without_markup(F.coalesce(html_text, F.lit("")), ""))


def spaced_text(html_text: Column, separator: str = " ") -> Column:
    """Stripped non-blank text pieces joined by ``separator``."""
    text = decode_entities(_without_markup(F.coalesce(html_text, F.lit("")), SEP))

    def pieces(t: Column) -> Column:
        joined = F.array_join(F.filter(F.transform(F.split(t, SEP), strip), lambda p: p != ""), separator)
        return F.when(t.contains(SEP), joined).otherwise(strip(t))

    return let(text, pieces)


def clean_html(html_text: Column, limit: int | None = None) -> Column:
    """One line of text; cut at ``limit`` characters if one is given."""
    line = collapse(spaced_text(html_text))
    return line if limit is None else let(line, lambda whole: clip(whole, limit))


# --------------------------------------------------------------------------
# Node table
# --------------------------------------------------------------------------

# Elements without content, elements whose text is not content,
# and the attributes any selector looks at.
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT_TAGS = frozenset({"script", "style", "template"})
NODE_ATTRS = {"class": "cls", "href": "href", "data-testid": "testid", "data-job-id": "jobid", "aria-label": "label"}

NODE_FIELDS = {"lo": pa.int32(), "hi": pa.int32(), "tag": pa.string()} | {name: pa.string() for name in (*NODE_ATTRS.values(), "text")}
NODE_TYPE = T.ArrayType(
    T.StructType(
        [T.StructField("lo", T.IntegerType()), T.StructField("hi", T.IntegerType()), T.StructField("tag", T.StringType())]
        + [T.StructField(field, T.StringType()) for field in NODE_ATTRS.values()]
        + [T.StructField("text", T.StringType())]
    )
)


class _Nodes(HTMLParser):
    """Number nodes in document order; ``[lo, hi)`` spans an element's content."""

    def __init__(self, entities: dict[str, str]) -> None:
        super().__init__(convert_charrefs=False)
        self.entities, self.nodes, self.open, self.pending = entities, [], [], []

    def flush(self) -> None:
        text = "".join(self.pending)
        self.pending.clear()
        if text and not (self.open and self.open[-1]["tag"] in SILENT_TAGS):
            n = len(self.nodes)
            self.nodes.append({"lo": n, "hi": n + 1, "tag": "", "text": text})

    def handle_starttag(self, tag, attrs):
        self.flush()
        node = {"lo": len(self.nodes), "hi": None, "tag": tag}
        node.update({NODE_ATTRS[k]: v or "" for k, v in attrs if k in NODE_ATTRS})
        self.nodes.append(node)
        if tag in VOID_TAGS:
            node["hi"] = len(self.nodes)
        else:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.flush()
        if any(node["tag"] == tag for node in self.open):
            while True:
                node = self.open.pop()
                node["hi"] = len(self.nodes)
                if node["tag"] == tag:
                    return

    def handle_data(self, data):
        self.pending.append(data)

    def handle_entityref(self, name):
        self.pending.append(self.entities.get(name, "&" + name))

    def handle_charref(self, name):
        digits, base = (name[1:], 16) if name[0] in "xX" else (name, 10)
        # No code point has more digits; longer numbers would only cost time.
        code = int(digits, base) if 0 < len(digits.lstrip("0")) <= 8 else 0
        valid = 0 < code <= 0x10FFFF and not 0xD800 <= code <= 0xDFFF
        self.pending.append(self.entities.get(f"#{code}") or (chr(code) if valid else "�"))

    def handle_comment(self, data):
        self.flush()

    handle_decl = handle_pi = unknown_decl = handle_comment


# Markup that reads the same by one pattern as by the tokenizer: text, tags with quoted or no values, scripts and styles without
# markup, named references, plain comments and the document type. A page with anything else goes to the tokenizer whole.
_PLAIN_ATTR = r"""[ \t\n]+{0}[A-Za-z][A-Za-z0-9-]*{1}(?:="{0}[^"&]*{1}"|='{0}[^'&]*{1}')?(?![^ \t\n/>])"""
_PLAIN_ATTRS = f"((?:{_PLAIN_ATTR.format('', '')})*)"
PLAIN_ATTR = re.compile(_PLAIN_ATTR.format("(", ")"))
PLAIN_MARKUP = re.compile(
    r"([^<&]+)"
    rf"|<((?i:script|style)){_PLAIN_ATTRS}[ \t\n]*>([^<&]*)</(?i:\2)>"
    rf"|<([A-Za-z][A-Za-z0-9]*){_PLAIN_ATTRS}[ \t\n]*(/?)>"
    r"|</([A-Za-z][A-Za-z0-9]*)>"
    r"|&([A-Za-z][A-Za-z0-9]*);"
    r"|(<!--[^<>&-]*-->|<!(?i:doctype) html>)"
    r"|(.)",
    re.S,
)
# Elements whose text the tokenizer, or some version of it, reads by rules of its own.
RAW_TEXT_TAGS = frozenset("iframe noembed noframes noscript plaintext script style svg math template textarea title xmp".split())


ATTR_PLACES = {attr: list(NODE_FIELDS).index(name) for attr, name in NODE_ATTRS.items()}


def plain_nodes(page: str, entities: dict[str, str]) -> list[list] | None:
    """Nodes of a page of plain markup as rows of ``NODE_FIELDS``, those of ``_Nodes``; null if a piece of it is not plain."""
    nodes: list[list] = []
    above: list[list] = []
    pending = ""
    for text, raw, raw_attrs, raw_text, tag, attrs, slash, end, name, silent, odd in PLAIN_MARKUP.findall(page):
        if text:
            pending += text
            continue
        if name:
            pending += entities.get(name, "&" + name)
            continue
        if odd:
            return None
        n = len(nodes)
        if pending:
            nodes.append([n, n + 1, "", None, None, None, None, None, pending])
            pending, n = "", n + 1
        if end:
            low = end.lower()
            if above and above[-1][2] == low:
                above.pop()[1] = n
            elif any(node[2] == low for node in above):
                while above[-1][2] != low:
                    above.pop()[1] = n
                above.pop()[1] = n
        elif not silent:
            low = (raw or tag).lower()
            if tag and low in RAW_TEXT_TAGS:
                return None
            node = [n, n + 1, low, None, None, None, None, None, None]
            nodes.append(node)
            if attrs or raw_attrs:
                for key, a, b in PLAIN_ATTR.findall(attrs or raw_attrs):
                    if place := ATTR_PLACES.get(key.lower()):
                        node[place] = a or b
            if not (raw or slash or low in VOID_TAGS):
                above.append(node)
    if pending:
        nodes.append([len(nodes), len(nodes) + 1, "", None, None, None, None, None, pending])
    for node in above:
        node[1] = len(nodes)
    return nodes


@F.arrow_udf(NODE_TYPE)
def html_nodes(pages: pa.Array) -> pa.Array:
    """Every page as an array of element and text nodes in document order."""
    entities = entity_table()

    def nodes(page: str | None) -> list[list] | None:
        found = plain_nodes(page, entities) if page else []
        if found is not None:
            return found
        parser = _Nodes(entities)
        try:
            parser.feed(page)
            parser.close()
        except (AssertionError, ValueError):
            return None  # a page the tokenizer can't read must not end the job
        parser.flush()
        for node in parser.open:
            node["hi"] = len(parser.nodes)
        return [[n.get(name) for name in NODE_FIELDS] for n in parser.nodes]

    # Column by column, which Arrow takes in far faster than row by row.
    columns: list[list] = [[] for _ in NODE_FIELDS]
    offsets: list[int | None] = []
    total = 0
    for page in pages:
        found = nodes(page.as_py())
        offsets.append(None if found is None else total)
        total += len(found or ())
        for column, values in zip(columns, zip(*found or ())):
            column.extend(values)
    arrays = [pa.array(values, kind) for values, kind in zip(columns, NODE_FIELDS.values())]
    return pa.ListArray.from_arrays(pa.array([*offsets, total], pa.int32()), pa.StructArray.from_arrays(arrays, list(NODE_FIELDS)))


# A selector is a function (node, nodes) -> boolean column.


def element(tag: str | None = None, cls: str | None = None, cls_has: str | None = None,
            testid: str | None = None, testid_has: str | None = None, href_has: str | None = None,
            has: str | None = None, label: str | None = None):
    """Match one element by tag, class token, class substring or attribute."""

    def test(n: Column, nodes: Column) -> Column:
        checks = [n["tag"] == tag if tag else n["tag"] != ""]
        if cls:
            token = F.concat(F.lit(" "), F.regexp_replace(n["cls"], r"\s", " "), F.lit(" ")).contains(f" {cls} ")
            checks += [n["cls"].contains(cls), token]
        if cls_has:
            checks.append(n["cls"].contains(cls_has))
        if testid:
            checks.append(n["testid"] == testid)
        if testid_has:
            checks.append(n["testid"].contains(testid_has))
        if href_has:
            checks.append(n["href"].contains(href_has))
        if has:
            checks.append(n[has].isNotNull())
        if label:
            checks.append(n["label"] == label)
        return F.coalesce(reduce(lambda a, b: a & b, checks), F.lit(False))

    return test


def any_of(*selectors):
    return lambda n, nodes: reduce(lambda a, b: a | b, [s(n, nodes) for s in selectors])


def inside(*chain):
    """Descendant chain: each selector must match an ancestor of the next one."""
    *outer, last = chain
    if not outer:
        return last
    ancestor = inside(*outer)

    def test(n: Column, nodes: Column) -> Column:
        return last(n, nodes) & F.exists(nodes, lambda p: _covers(p, n) & ancestor(p, nodes))

    test.parts = ancestor, last
    return test


def below_root(selector, root: Column):
    """The same selector for nodes below ``root`` only; ``root`` itself can still be an ancestor in a chain."""
    def test(n: Column, nodes: Column) -> Column:
        return (n["lo"] > root["lo"]) & selector(n, nodes)

    if hasattr(selector, "parts"):
        ancestor, last = selector.parts
        test.parts = ancestor, below_root(last, root)
    return test


def _covers(outer: Column, n: Column) -> Column:
    return (outer["lo"] < n["lo"]) & (outer["hi"] >= n["hi"])


def select_all(nodes: Column, selector) -> Column:
    """Matching nodes. Of a chain the outer hits are found first, once; without any, no node is looked at for the rest."""
    if not hasattr(selector, "parts"):
        return F.filter(nodes, lambda n: selector(n, nodes))
    ancestor, last = selector.parts

    def within(outer: Column) -> Column:
        return F.filter(nodes, lambda n: (F.size(outer) > 0) & last(n, nodes) & F.exists(outer, lambda p: _covers(p, n)))

    return let(select_all(nodes, ancestor), within)


def select_one(nodes: Column, selector) -> Column:
    return F.try_element_at(select_all(nodes, selector), F.lit(1))


def content(nodes: Column, node: Column) -> Column:
    """The nodes below ``node``, of an array without gaps: nodes stand in document order, so they are a slice."""
    first = F.get(nodes, F.lit(0))["lo"]
    return F.slice(nodes, node["lo"] - first + 2, node["hi"] - node["lo"] - 1)


def without(nodes: Column, selector) -> Column:
    """Remove matching elements together with everything below them."""
    return let(
        select_all(nodes, selector),
        lambda cut: F.when(F.size(cut) == 0, nodes).otherwise(
            F.filter(nodes, lambda n: ~F.exists(cut, lambda d: (d["lo"] <= n["lo"]) & (d["hi"] >= n["hi"])))
        ),
    )


def text_of(nodes: Column, node: Column, separator: str = "", gaps: bool = False) -> Column:
    """Stripped text pieces below ``node``; the node is looked up once, not per piece.

    ``gaps`` tells that nodes were taken out of the array, so all of it has to be looked at.
    """
    def pieces(found: Column) -> Column:
        if gaps:
            inner = F.filter(nodes, lambda t: (t["tag"] == "") & _covers(found, t))
        else:
            inner = F.filter(content(nodes, found), lambda t: t["tag"] == "")
        stripped = F.filter(F.transform(inner, lambda t: strip(t["text"])), lambda s: s != "")
        return F.when(found.isNotNull(), F.array_join(stripped, separator))

    return let(node, pieces)


def first_text(nodes: Column, *selectors) -> Column:
    """Selector waterfall: the first selector whose first hit has text, else ``""``."""
    tries = [
        first_where(F.array(text_of(nodes, select_one(nodes, s))), lambda t: t != "") for s in selectors
    ]
    return F.coalesce(*tries, F.lit(""))


def first_href(nodes: Column, *selectors) -> Column:
    tries = [first_where(F.array(select_one(nodes, s)["href"]), lambda t: t != "") for s in selectors]
    return F.coalesce(*tries, F.lit(""))


def body_text(nodes: Column, chrome, containers, minimum: int = 80) -> Column:
    """Main text of a page: drop ``chrome``, then the first container with enough text.

    Text pieces are joined by line breaks; three or more breaks become two.
    """
    kept = without(nodes, chrome)

    def container_text(selector):
        def of(ns: Column) -> Column:
            joined = F.regexp_replace(text_of(ns, select_one(ns, selector), "\n", gaps=True), r"\n{3,}", "\n\n")
            return first_where(F.array(strip(joined)), lambda t: F.length(t) > minimum)

        return of

    return let(kept, lambda ns: F.coalesce(*[container_text(s)(ns) for s in containers], F.lit("")))
