"""HTML to page records: one pass over the markup in Arrow batches, and native twins of the simple extractions."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.functions import lexicons as lx

_DROP = {"script", "style", "noscript", "template", "svg", "iframe"}
_VOID = {"meta", "link", "img", "br", "input", "hr", "area", "base", "col", "embed", "source", "track", "wbr"}

FORM = "struct<has_email:boolean,has_phone:boolean,has_message:boolean,is_search:boolean,is_newsletter:boolean,inputs:int,unlabelled:int>"
LINK = "struct<href:string,text:string>"
BLOCK = "struct<types:array<string>,name:string,address:boolean,hours:boolean,same_as:boolean>"
#: The page record that parse() adds.
FIELDS = {
    "title": "string", "description": "string", "robots": "string", "viewport": "string", "canonical": "string",
    "lang": "string", "charset": "string", "h1": "array<string>", "h2": "array<string>", "h3": "array<string>",
    "text": "string", "words": "int", "links": f"array<{LINK}>", "mailto": "array<string>", "tel": "array<string>",
    "whatsapp": "array<string>", "social": "array<string>", "empty_links": "int", "images": "int",
    "images_alt": "int", "image_srcs": "array<string>", "forms": f"array<{FORM}>", "buttons": "array<string>",
    "scripts": "array<string>", "blocking": "int", "stylesheets": "array<string>", "styles": "array<string>",
    "iframes": "array<string>", "jsonld": "array<string>", "jsonld_emails": "array<string>", "blocks": f"array<{BLOCK}>", "schema_types": "array<string>",
    "og": "map<string,string>", "twitter": "map<string,string>", "hreflang": "array<string>", "has_main": "boolean", "has_nav": "boolean",
    "has_skip": "boolean", "header": "string", "footer": "string", "fold": "string", "has_plugin": "boolean",
    "names": "array<string>", "has_menu": "boolean", "has_platform": "boolean", "attr_widths": "array<int>", "noscript_only": "boolean",
}

# --- fixed values: what links, menus, plugins and widths are told by
_MAILTO, _TEL = re.compile(r"^mailto:([^?]+)", re.I), re.compile(r"^(?:tel|callto):(.+)", re.I)
_CHAT = re.compile(r"(wa\.me/|api\.whatsapp\.com|whatsapp://|web\.whatsapp\.com)", re.I)
_NO_PAGE = re.compile(r"(#|(mailto|tel|javascript|data|sms|whatsapp|callto):)", re.I)
_MENU = re.compile(r"(hamburger|mobile-menu|menu-toggle|navbar-toggle|nav-toggle|burger)", re.I)
_PLUGIN = re.compile(r"<(object|embed|applet)\b", re.I)
_ATTR_WIDTH = re.compile(r'<(?:table|div|img)[^>]+width\s*=\s*"?(\d{3,5})', re.I)
#: Comments in a row, none with a dash or a bracket in it, so that each ends at its first mark.
_COMMENTS = re.compile("(?:<!--[^->]+-->)++")
#: Tags as most are written, whose end and attributes do not depend on what follows them; names whose content is no markup.
_TAG, _ATTRIBUTE = re.compile('<([a-z][a-z0-9]*)((?: [a-z][a-z0-9:-]*(?:="[^"<>&]*")?)*)>'), re.compile(' ([a-z][a-z0-9:-]*)(?:="([^"]*)")?')
_END = re.compile("</([a-z][a-z0-9]*)>")
_OPAQUE = {"script", "style", "title", "textarea", "xmp", "iframe", "noembed", "noframes", "noscript", "plaintext"}
#: Characters of the markup that menus, plugins and widths are looked for in; of a header or a footer; of the body above the fold.
MARKUP, FRAME, FOLD = 200_000, 60_000, 18_000


def _clean(text: str, limit: int | None = None) -> str:
    return " ".join(text.split())[:limit]


_LABEL, _NAME = re.compile(lx.NAME_LABEL), re.compile(lx.NAME)


def _names(headings: list[str], text: str) -> list[str]:
    """The first five names of two capitalised words in headings and within 90 characters of a word for a role."""
    near = [text[max(0, m.start() - 90) : m.end() + 90] for m in _LABEL.finditer(text)]
    pairs = [m.groups() for w in headings + near for m in _NAME.finditer(w)]
    return [f"{a} {b}" for a, b in pairs if a.lower() not in lx.NO_NAMES and b.lower() not in lx.NO_NAMES][:5]


def _emails(value) -> Iterator[str]:
    """The strings that stand under a key "email" of a JSON value, at any depth, in the order of the text."""
    todo = [value]
    while todo:
        v = todo.pop()
        if isinstance(v, str):
            yield v
        elif isinstance(v, dict):
            todo += [x for k, x in reversed(v.items()) if isinstance(x, (dict, list)) or isinstance(x, str) and k.lower() == "email"]
        elif isinstance(v, list):
            todo += [x for x in reversed(v) if isinstance(x, (dict, list))]


class _Reader(HTMLParser):
    """Collects a page record from the events of one document."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.r: dict = {k: "" if t == "string" else 0 if t == "int" else False if t == "boolean" else {} if t[0] == "m" else [] for k, t in FIELDS.items()}
        self.open: list[tuple[str, list[str], str | None]] = []  # elements whose text is wanted; of a button, its value
        self.dropped: list[str] = []
        self.body: list[str] = []
        self.in_body = False
        self.markup: list[str] = []  # the body's markup above the fold
        self.markup_size = 0
        self.zones: dict[str, tuple[int, list[str]]] = {}  # header and footer: depth, markup; depth 0 once closed
        self.form: dict | None = None
        self.labels: set[str] = set()
        self.fields: list[tuple[dict, str, bool]] = []
        self.link: dict | None = None
        self.in_label = 0
        self.raw = ""  # the start tag at hand, where it is a plain one

    def updatepos(self, i, j):
        """Lines and columns are not asked for, so they are not counted."""
        return j

    def parse_comment(self, i, report=1):
        """Comments are not looked at, so a run of them is one step."""
        run = _COMMENTS.match(self.rawdata, i)
        return run.end() if run else super().parse_comment(i, report)

    def parse_starttag(self, i):
        plain = _TAG.match(self.rawdata, i)
        if plain is None or plain[1] in _OPAQUE:
            self.raw = ""
            return super().parse_starttag(i)
        self.raw = plain[0]
        self.handle_starttag(plain[1], _ATTRIBUTE.findall(plain[2]) if plain[2] else [])
        return plain.end()

    def parse_endtag(self, i):
        plain = None if self.cdata_elem else _END.match(self.rawdata, i)
        if plain is None:
            return super().parse_endtag(i)
        self.handle_endtag(plain[1])
        return plain.end()

    def handle_starttag(self, tag, attrs):
        a = {k: (v or "") for k, v in attrs}
        r = self.r
        raw = self.raw or self.get_starttag_text() or ""
        if self.zones or tag in ("header", "footer") or "id" in a or "class" in a:
            self._frame(tag, a, raw)
        if self.in_body and not self.dropped and tag not in _DROP:
            self._mark(raw)
        self.in_body |= tag == "body"
        self.body.append(" ")
        if tag == "html":
            r["lang"] = r["lang"] or a.get("lang", "").strip()
        elif tag == "meta":
            self._meta(a)
        elif tag == "link":
            rel = a.get("rel", "")
            if rel == "canonical":
                r["canonical"] = r["canonical"] or a.get("href", "").strip()
            elif rel == "stylesheet":
                r["stylesheets"].append(a.get("href", ""))
            elif rel == "alternate" and a.get("hreflang"):
                r["hreflang"].append(a["hreflang"])
        elif tag == "img":
            r["images"] += 1
            r["image_srcs"].append(a.get("src", ""))
            r["images_alt"] += bool(a.get("alt", "").strip())
            if self.link is not None and a.get("alt", "").strip():
                self.link["named"] = True
        elif tag == "iframe":
            r["iframes"].append(a.get("src", ""))
        elif tag == "script" and "src" in a:
            r["scripts"].append(a["src"])
            r["blocking"] += "async" not in a and "defer" not in a and a.get("type", "") not in ("module", "application/json", "application/ld+json")
        elif tag == "label":
            self.in_label += 1
            self.labels.add(a.get("for", ""))
        elif tag == "form":
            self.form = {"has_email": False, "has_phone": False, "has_message": False, "is_search": "search" in str(a).lower(), "is_newsletter": "newsletter" in str(a).lower() or "subscribe" in str(a).lower(), "inputs": 0, "unlabelled": 0}
            r["forms"].append(self.form)
        elif tag == "a":
            self.link = {"href": a.get("href", "").strip(), "named": bool(a.get("aria-label") or a.get("title"))}
        if tag in ("input", "textarea", "select") and self.form is not None:
            self._field(tag, a)
        if tag == "nav":
            r["has_nav"] = True
        if tag == "main" or a.get("role") == "main":
            r["has_main"] = True
        as_button = tag == "button" or a.get("role") == "button" or bool({"btn", "button"} & set(a.get("class", "").split()))
        if tag == "input" and (a.get("type") == "submit" or as_button):
            self._button(a.get("value", ""))
        if tag in _DROP:
            self.dropped.append(tag)
        wanted = tag in ("title", "h1", "h2", "h3", "a", "button", "style") or tag == "script" and a.get("type") == "application/ld+json"
        if tag not in _VOID and (wanted or as_button):
            self.open.append((tag, [], a.get("value", "") if as_button else None))

    def _button(self, label):
        label = _clean(label, 120)
        if label and label not in self.r["buttons"] and len(self.r["buttons"]) < 60:
            self.r["buttons"].append(label)

    def _mark(self, markup):
        if self.markup_size < FOLD:
            self.markup.append(markup)
            self.markup_size += len(markup)

    def _frame(self, tag, a, raw):
        """Keeps the markup of the first header and the first footer, by tag, id or class."""
        for zone in ("header", "footer"):
            depth, parts = self.zones.get(zone, (0, []))
            if depth or zone not in self.zones and (tag == zone or a.get("id") == zone or zone in a.get("class", "").split()):
                self.zones[zone] = (depth + (tag not in _VOID), parts + [raw] if not parts else parts)
                if parts:
                    parts.append(raw)

    def _meta(self, a):
        r, name, prop, content = self.r, a.get("name", "").lower(), a.get("property", "").lower(), a.get("content", "")
        if "charset" in a:
            r["charset"] = a["charset"]
        if (name == "description" or prop == "og:description") and not r["description"]:
            r["description"] = _clean(content, 1000)
        if name in ("robots", "viewport"):
            r[name] = content.strip().lower()
        for prefix, into in (("og:", "og"), ("twitter:", "twitter")):
            for key in (prop, name):
                if key.startswith(prefix):
                    r[into].setdefault(key[len(prefix) :], content[:500])

    def _field(self, tag, a):
        kind = a.get("type", "text").lower() if tag == "input" else tag
        if kind in ("hidden", "submit", "button", "image"):
            return
        f, about = self.form, f"{kind} {a.get('name', '')} {a.get('id', '')} {a.get('placeholder', '')}".lower()
        f["inputs"] += 1
        f["has_email"] |= "email" in about or "e-mail" in about
        f["has_phone"] |= "tel" in about or "phone" in about
        f["has_message"] |= kind == "textarea" or "message" in about
        f["is_search"] |= kind == "search"
        named = bool(self.in_label or a.get("aria-label") or a.get("aria-labelledby") or a.get("title"))
        self.fields.append((f, a.get("id", ""), named))

    def handle_endtag(self, tag):
        for zone, (depth, parts) in self.zones.items():
            if depth and tag not in _VOID:
                parts.append(f"</{tag}>")
                self.zones[zone] = (depth - 1, parts)
        if self.in_body and not self.dropped:
            self._mark(f"</{tag}>")
        self.body.append(" ")
        if self.dropped and self.dropped[-1] == tag:
            self.dropped.pop()
        if tag == "form":
            self.form = None
        if tag == "label" and self.in_label:
            self.in_label -= 1
        at = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i][0] == tag), None)
        if at is not None:
            _, parts, value = self.open[at]
            text = "".join(parts)
            if value is not None:
                self._button(_clean(text) or value)
            self._closed(tag, text)
            del self.open[at]

    def _closed(self, tag, text):
        r, flat = self.r, _clean(text)
        if tag == "title":
            r["title"] = r["title"] or flat[:500]
        elif tag in ("h1", "h2", "h3"):
            if flat and (tag == "h1" or len(r[tag]) < 40):
                r[tag].append(flat[:300])
        elif tag == "a" and self.link is not None:
            self._routed(self.link["href"], flat[:200])
            self.link = None
        elif tag == "style":
            r["styles"].append(text[:20_000])
        elif tag == "script":
            self._schema(text)

    def _routed(self, href, text):
        """A link goes to the addresses, numbers or chats, or to the links (and social profiles to both)."""
        r = self.r
        if not href:
            return
        r["empty_links"] += not text and not self.link["named"]
        r["has_skip"] |= href.startswith("#") and bool(re.search("skip.*(content|main|navigation)", text.lower()))
        for pattern, kind in ((_MAILTO, "mailto"), (_TEL, "tel")):
            if m := pattern.match(href):
                value = m.group(1).strip()
                value = value.replace("%20", "").lower() if kind == "mailto" else value
                if value and value not in r[kind]:
                    r[kind].append(value)
                return
        if _CHAT.search(href):
            if href not in r["whatsapp"]:
                r["whatsapp"].append(href)
            return
        if any(d in href.lower() for d in lx.SOCIAL_LINKS) and href not in r["social"] and len(r["social"]) < 20:
            r["social"].append(href)
        if _NO_PAGE.match(href):
            return
        r["links"].append({"href": href, "text": text})

    def _schema(self, text):
        try:
            found = json.loads(text)
        except ValueError:
            return
        for x in found if isinstance(found, list) else [found]:
            inner = x.get("@graph") if isinstance(x, dict) else None
            for y in inner if isinstance(inner, list) else [x]:
                if isinstance(y, dict):
                    self.r["jsonld"].append(json.dumps(y))
                    self.r["jsonld_emails"] += _emails(y)
                    kinds = y.get("@type") or y.get("type") or []
                    kinds = [k for k in ([kinds] if isinstance(kinds, str) else kinds) if isinstance(k, str)]
                    self.r["schema_types"] += kinds
                    same = y.get("sameAs")
                    self.r["blocks"].append({
                        "types": kinds, "name": y["name"] if isinstance(y.get("name"), str) else "", "address": bool(y.get("address")),
                        "hours": any("openinghours" in str(k).lower() for k in y),
                        "same_as": isinstance(same, str) or isinstance(same, list) and any(isinstance(x, str) for x in same),
                    })

    def handle_data(self, data):
        for _, into, _ in self.open:
            into.append(data)
        if not self.dropped and not (self.open and self.open[-1][0] == "title"):
            self.body.append(data)
            if self.in_body:
                self._mark(data)
        for depth, parts in self.zones.values():
            if depth:
                parts.append(data)

    def record(self, html: str, names: bool = True) -> dict:
        r = self.r
        r["text"] = _clean("".join(self.body))
        r["words"] = len(r["text"].split())
        for zone in ("header", "footer"):
            r[zone] = "".join(self.zones.get(zone, (0, []))[1])[:FRAME]
        r["fold"] = (r["header"] + "".join(self.markup)[:FOLD]).lower()
        r["schema_types"] = list(dict.fromkeys(r["schema_types"]))
        for f, ident, named in self.fields:
            f["unlabelled"] += not named and (not ident or ident not in self.labels)
        part = html[:MARKUP]
        r["has_menu"], r["has_plugin"] = bool(_MENU.search(part)), bool(_PLUGIN.search(part))
        r["attr_widths"] = [int(x) for x in _ATTR_WIDTH.findall(part)]
        low = html.lower()
        r["has_platform"] = any(p in low for p in lx.BOOKING_PLATFORMS)
        if names:
            r["names"] = _names(r["h2"] + r["h3"], r["text"])
        r["noscript_only"] = r["words"] < 30 and len(r["scripts"]) > 3
        return r | {"og": list(r["og"].items()), "twitter": list(r["twitter"].items())}


def read_html(html: str | None, names: bool = True) -> dict:
    """The record of a page; names are looked for if they are asked for."""
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    return reader.record(html or "", names)


def _arrow(kind: str) -> pa.DataType:
    plain = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}
    if kind in plain:
        return plain[kind]
    if kind.startswith("array"):
        return pa.list_(_arrow(kind[6:-1]))
    if kind.startswith("map"):
        return pa.map_(pa.string(), pa.string())
    return pa.struct([(n, _arrow(t)) for n, t in (x.split(":") for x in kind[7:-1].split(","))])


def parse(pages: DataFrame, html_col: str = "html", fields: tuple[str, ...] | None = None, with_lead: bool | None = None) -> DataFrame:
    """pages with the columns of FIELDS (or those of fields alone) in place of their html, bytes, the html's length, and lead. No row moves.

    lead is there if all columns are, or as with_lead says. It is the text of the pages that can be among the first LEAD characters of their site (by the columns
    site and page_id, where pages has them), else null: pages of a batch behind others of their site that
    fill it have none.
    """
    keep = [f for f in pages.schema if f.name != html_col]
    names = [f.name for f in keep]
    wanted = {k: t for k, t in FIELDS.items() if fields is None or k in fields}
    with_lead = fields is None if with_lead is None else with_lead
    more = ["bytes int"] + [f"{k} {t}" for k, t in wanted.items()] + (["lead string"] if with_lead else [])
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in keep] + more)
    by_site = "site" in names and "page_id" in names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                html = part.column(part.num_columns - 1).to_pylist()
                rows = [read_html(h, "names" in wanted) for h in html]
                cols = [part.column(i) for i in range(len(keep))] + [pa.array([len(h or "") for h in html], pa.int32())]
                cols += [pa.array([r[k] for r in rows], _arrow(t)) for k, t in wanted.items()]
                if not with_lead:
                    yield pa.RecordBatch.from_arrays(cols, names=names + ["bytes", *wanted])
                    continue
                lead = [r["text"][:LEAD] for r in rows]
                if by_site:
                    lead = _leading(lead, part.column(names.index("site")).to_pylist(), part.column(names.index("page_id")).to_pylist())
                yield pa.RecordBatch.from_arrays(cols + [pa.array(lead, pa.string())], names=names + ["bytes", *wanted, "lead"])

    return pages.select(*names, html_col).mapInArrow(run, schema)


#: Characters of a site's pages, in order, that the rules look for wordings in.
LEAD = 60_000


def _leading(texts: list[str], sites: list, order: list) -> list[str | None]:
    """texts, without those behind LEAD characters of their site's."""
    out: list[str | None] = list(texts)
    filled: dict = {}
    for i in sorted(range(len(texts)), key=lambda i: (order[i] is None, order[i])):
        size = filled.get(sites[i], 0)
        if size >= LEAD:
            out[i] = None
        filled[sites[i]] = size + len(texts[i]) + 1
    return out


# --- native twins


def unescape(c: Column) -> Column:
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _flat(c: Column) -> Column:
    return F.trim(F.regexp_replace(unescape(F.regexp_replace(c, "<[^>]*>", "")), r"[ \t\n\r]+", " "))


def title(html: Column) -> Column:
    return _flat(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def headings(html: Column, level: int) -> Column:
    found = F.regexp_extract_all(html, F.lit(rf"(?is)<h{level}[^>]*>(.*?)</h{level}>"), F.lit(1))
    return F.filter(F.transform(found, _flat), lambda h: h != "")


def language(html: Column) -> Column:
    return F.regexp_extract(html, r'(?i)<html[^>]*\blang="([^"]*)"', 1)


def hrefs(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r'(?i)<a[^>]*\bhref="([^"]*)"'), F.lit(1))


def visible_text(html: Column) -> Column:
    """The text of the body, without scripts, styles and comments; white space collapsed."""
    body = F.regexp_replace(html, r"(?is)<(script|style|noscript|template|svg|iframe|title)[^>]*>.*?</(script|style|noscript|template|svg|iframe|title)>", " ")
    body = F.regexp_replace(F.regexp_replace(body, r"(?s)<!--.*?-->", ""), "<[^>]*>", " ")
    return F.trim(F.regexp_replace(unescape(body), r"[ \t\n\r]+", " "))
