"""Main-text extraction by consensus host paths.

Each page's containers are scored by the text that stands in them, less their links. The pages of a host vote with their best
container's path (tags and classes, digits generalised); Spark counts the votes, and every page is read again: what stands
under the winning path is its text, or, where the page has no such path, what stands in its own best container. Either is
widened to the article (or main) element around it, or else to what contains it as long as that adds nothing but paragraphs
without links, so that headings, leads and further sections of an article stay with it.

Inside, only what is named as a menu, header, footer, sidebar, notice, advert, form or comment section goes, as whole
containers: classes of paragraphs, headings, list items, cells and inline elements decide nothing.

Null html and pages without text give an empty text; broken markup is read as far as it goes; a null url is a host of its own;
repeated rows are read one by one, an empty table gives an empty result, and further columns, whatever their names, stay where
`carry` names them. Reading takes time and memory in proportion to the page, however long, deep or broken.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.reputation import host_of
from quantloom.llm.shared import stored

#: A host table of more rows than this is joined by a shuffle (salted), not broadcast; a row is about 200 bytes.
BROADCAST_HOSTS = 200_000
SALTS = 16
#: Tags whose contents are never text, and tags that hold menus, notices and the like (fixed values).
HIDDEN = frozenset("script style noscript template iframe object svg head title textarea select option canvas audio video".split())
ASIDE = frozenset("nav header footer aside form button menu dialog".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Tags whose start ends an open one of the same kind (fixed values).
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
#: Tags that hold a paragraph's text rather than an article's paragraphs.
LEAF = frozenset("figcaption p h1 h2 h3 h4 h5 h6 li dd dt blockquote pre td th tr ul ol dl tbody table".split())
#: Tags whose classes never make them boilerplate: text itself, and what holds a whole page or article.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li dd dt blockquote pre td th tr figcaption html body article main".split())
#: Class and id words of what is not main text (fixed values).
BOILERPLATE = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adv|advert|advertisement|banner|breadcrumbs?|comments?|cookies?|consent|disqus|footer|header|login|masthead|menu|modal|nav|navbar|navigation|newsletter|notice|pager|pagination|popup|promo|promoted|related|replies|share|sharing|sidebar|signup|social|sponsor|sponsored|subscribe|tags|toolbar|widget)(?:$|[\s_-])",
    re.I,
)
# A tag that is not closed before the next < is text; so no match looks further than that.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([a-zA-Z][^\s/><]*)((?:\"[^\"]*\"|'[^']*'|[^\"'><])*)>|<[!?][^<>]*>|[^<]+|<[^<]*", re.S)
_CLASS = re.compile(r"\b(class|id|role|hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_RAW = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in ("script", "style", "textarea", "title", "noscript", "iframe", "template")}


@dataclass
class Container:
    """A container: the one around it, its tag, and a digest of the path of tags and classes down to it."""

    above: int
    tag: str
    path: str


@dataclass
class Block:
    """A run of text: its innermost container, whether it is a paragraph or the like, and how much of it is links."""

    container: int
    prose: bool
    parts: list[str] = field(default_factory=list)
    linked: int = 0

    @property
    def text(self) -> str:
        return " ".join("".join(self.parts).split(None))


@dataclass
class Open:
    """An element that is open: its container, whether it is left out, a link, a paragraph or inside an article."""

    tag: str
    container: int
    out: bool
    link: bool
    prose: bool
    article: bool
    inline: dict[str, int] = field(default_factory=dict)  # of a block: inline elements open right inside it


def _name(tag: str, attributes: str) -> tuple[str, bool]:
    """Tag with its classes, digits generalised, and whether they tell of boilerplate."""
    if not attributes.strip():
        return tag, False
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _CLASS.finditer(attributes)}
    classes = sorted(set(re.sub(r"\d+", "#", found.get("class", "")).split()))
    odd = bool(BOILERPLATE.search(" ".join((found.get("class", ""), found.get("id", ""))))) or found.get("role") in ("navigation", "banner", "contentinfo", "complementary", "search")
    return ".".join([tag, *classes]), "hidden" in found or odd and tag in BLOCK and tag not in PROSE


def _path(above: str, name: str) -> str:
    return hashlib.blake2b(f"{above}>{name}".encode(), digest_size=12).hexdigest()


def read(page: str) -> tuple[list[Block], list[Container]]:
    """The page's blocks of visible text outside boilerplate in page order, and its containers, outer ones first."""
    found: list[Block] = []
    containers = [Container(-1, "", "")]
    stack = [Open("", 0, False, False, False, False)]
    counts: dict[str, int] = {}  # open blocks of each tag
    current: Block | None = None
    at = 0

    def close(k: int) -> None:
        """Ends the elements from the k-th on."""
        while len(stack) > k:
            gone = stack.pop()
            if gone.tag in BLOCK:
                counts[gone.tag] -= 1
                holder.pop()
            else:
                holder[-1][gone.tag] -= 1

    holder = [stack[0].inline]
    while m := _TOKEN.match(page, at):
        at = m.end()
        if m[2] is None:
            raw = m[0]
            if raw.startswith(("<!", "<?")) and (raw.endswith(">") or raw.startswith(("<!--", "<![CDATA["))) or stack[-1].out:
                continue
            text = entities.unescape(raw)
            if current is None:
                if not text.strip():
                    continue
                current = Block(stack[-1].container, stack[-1].prose)
                found.append(current)
            current.parts.append(text)
            if stack[-1].link:
                current.linked += len(text.strip())
            continue
        tag, ends = m[2].lower(), bool(m[1])
        block = tag in BLOCK
        if block:
            current = None
        elif tag == "br" and current is not None:
            current.parts.append(" ")
        if ends:
            # an inline element ends only inside its own block; what was never opened is passed over
            if (counts if block else holder[-1]).get(tag, 0):
                k = len(stack) - 1
                while stack[k].tag != tag:
                    k -= 1
                close(k)
            continue
        if tag in _RAW:
            stop = _RAW[tag].search(page, at)
            at = stop.end() if stop else len(page)
            continue
        if tag in VOID or m[3].endswith("/"):
            continue
        if block:  # a like block before this one ends, and inline elements that were left open end with their block
            if any(counts.get(t, 0) for t in CLOSES.get(tag, ())):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag in CLOSES[tag]:
                        close(k)
                        break
                    if stack[k].tag not in LEAF and stack[k].tag in BLOCK:
                        break
            k = len(stack)
            while k > 1 and stack[k - 1].tag not in BLOCK:
                k -= 1
            close(k)
        outer = stack[-1]
        name, odd = _name(tag, m[3])
        aside = tag in ASIDE and not (tag == "header" and outer.article)
        container = outer.container
        if block and tag not in LEAF:
            containers.append(Container(container, tag, _path(containers[container].path, name)))
            container = len(containers) - 1
        prose = tag in LEAF or outer.prose and not (block and tag not in LEAF)
        new = Open(tag, container, outer.out or tag in HIDDEN or aside or odd, outer.link or tag == "a", prose, outer.article or tag == "article")
        stack.append(new)
        if block:
            counts[tag] = counts.get(tag, 0) + 1
            holder.append(new.inline)
        else:
            holder[-1][tag] = holder[-1].get(tag, 0) + 1
    return [b for b in found if b.text], containers


def scored(found: list[Block], containers: list[Container]) -> dict[str, float]:
    """Score of each container path: its unlinked text, with seven tenths of what the containers in it score."""
    own = [0.0] * len(containers)
    for block in found:
        text = block.text
        own[block.container] += max(0.0, len(text) - 2.0 * block.linked) * (1.0 if len(text) >= 25 else 0.3)
    score: dict[str, float] = {}
    for k in range(len(containers) - 1, 0, -1):  # inner ones come later
        own[containers[k].above] += 0.7 * own[k]
        if own[k]:
            score[containers[k].path] = score.get(containers[k].path, 0.0) + own[k]
    return score


def best_path(found: list[Block], containers: list[Container]) -> str | None:
    score = scored(found, containers)
    return max(score, key=lambda p: (score[p], p)) if score else None


def _held(chosen: list[int], containers: list[Container]) -> list[bool]:
    """For each container whether it is, or is inside, one of the chosen."""
    held = [False] * len(containers)
    for k in chosen:
        held[k] = True
    for k in range(1, len(containers)):
        held[k] = held[k] or held[containers[k].above]
    return held


def _articles(containers: list[Container]) -> list[int]:
    """For each container the nearest article around it, itself included, or else the nearest main element, or else 0."""
    article, main = [0] * len(containers), [0] * len(containers)
    for k in range(1, len(containers)):
        above = containers[k].above
        article[k] = k if containers[k].tag == "article" else article[above]
        main[k] = k if containers[k].tag == "main" else main[above]
    return [a or m for a, m in zip(article, main)]


def _widened(chosen: list[int], found: list[Block], containers: list[Container]) -> int | None:
    """The outermost container around all the chosen that holds nothing besides them but paragraphs without links."""
    line = [chosen[0]]
    while containers[line[-1]].above > 0:
        line.append(containers[line[-1]].above)
    place = {c: i for i, c in enumerate(line)}
    meets = [-1] * len(containers)  # where on the line each container hangs
    for c in range(1, len(containers)):
        meets[c] = place.get(c, meets[containers[c].above])
    base = max(meets[k] for k in chosen)
    if base < 0 or any(meets[k] < 0 for k in chosen):
        return None
    held, plain = _held(chosen, containers), [True] * len(line)
    for block in found:
        at = meets[block.container]
        if at >= 0 and not held[block.container] and (not block.prose or block.linked * 5 > len(block.text)):
            plain[max(at, base)] = False
    out = None
    for i in range(base, len(line)):
        if not plain[i]:
            break
        out = line[i]
    return out


def _under(path: str | None, found: list[Block], containers: list[Container]) -> list[Block]:
    """The blocks under a path with the rest of their articles; none if nothing stands under it."""
    chosen = [k for k, c in enumerate(containers) if k and c.path == path]
    held = _held(chosen, containers)
    if not any(held[b.container] for b in found):
        return []
    article = _articles(containers)
    loose = [k for k in chosen if not article[k]]
    wider = _widened(loose, found, containers) if loose else None
    held = _held([*chosen, *(article[k] for k in chosen if article[k]), *([] if wider is None else [wider])], containers)
    return [b for b in found if held[b.container]]


def main_text(page: str, winner: str | None) -> str:
    """Text under the winning path, or in the page's own best container, with the rest of its article."""
    found, containers = read(page)
    inside = _under(winner, found, containers) or _under(best_path(found, containers), found, containers) or found
    return "\n".join(b.text for b in inside)


def votes(pages: DataFrame) -> DataFrame:
    """(host, path, n): how many pages of a host hold their best text under each path."""

    def vote(batches):
        for batch in batches:
            tally: dict[tuple[str, str], int] = {}
            for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
                path = best_path(*read(page or ""))
                if path is not None:
                    tally[host, path] = tally.get((host, path), 0) + 1
            yield pa.RecordBatch.from_pydict({"host": pa.array([h for h, _ in tally], pa.string()), "path": pa.array([p for _, p in tally], pa.string()), "n": pa.array(list(tally.values()), pa.int64())})

    return pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(vote, "host string, path string, n long").groupBy("host", "path").agg(F.sum("n").alias("n"))


def extract(pages: DataFrame, *carry: str) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page, with the `carry` columns; one named like a result gives way to it."""
    top = F.max(F.struct("n", "path"))["path"]
    winners = stored(votes(pages).groupBy("host").agg(top.alias("winner")), "winners")
    names = list(dict.fromkeys(["page_id", "url", *(c for c in carry if c not in ("text", "n_chars"))]))
    inner = [f"c{k}" for k in range(len(names))]  # carried columns may have any name
    rows = pages.select(*(F.col(c).alias(i) for c, i in zip(names, inner)), F.col("html").alias("page"), host_of(F.col("url")).alias("host"))
    if winners.count() <= BROADCAST_HOSTS:
        rows = rows.join(F.broadcast(winners), "host", "left")
    else:
        salted = winners.select("host", "winner", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("c1", "c0"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left")

    def run(batches):
        for batch in batches:
            texts = [main_text(page or "", winner) for page, winner in zip(batch.column("page").to_pylist(), batch.column("winner").to_pylist())]
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in inner} | {"text": pa.array(texts, pa.string())})

    schema = ", ".join([f"{i} {pages.schema[c].dataType.simpleString()}" for c, i in zip(names, inner)] + ["text string"])
    out = rows.select(*inner, "page", "winner").mapInArrow(run, schema)
    carried = [F.col(i).alias(c) for c, i in zip(names, inner)]
    return out.select(*carried[:2], "text", F.length("text").cast("long").alias("n_chars"), *carried[2:])
