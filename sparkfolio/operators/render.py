"""HTML rendering as expressions over the unified model: one stage, no shuffle, no Python.

Fragments (classes, inline styles, order of tags) are fixed formats; the page shell's style sheet and the PDF viewer's
script are this library's own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkfolio.functions.numbers import css_number
from sparkfolio.functions.text import base64_plain, html_escape
from sparkfolio.sources.pdf import MARKER

#: Values of the custom field `format` that have no pages (fixed values).
PAGELESS = ("EML", "MSG", "MBOX", "VCF", "ICS")
NEAR = 0.1
UNTITLED = "Untitled Document"
_STYLE = """
        body { margin: 0; padding: 2rem; font-family: sans-serif; background: #f4f4f4; }
        .container { max-width: 75rem; margin: 0 auto; padding: 2rem; background: #fff; }
        .page { margin-bottom: 2rem; padding: 1rem; }
        .text-content { white-space: pre-wrap; overflow-wrap: break-word; text-align: left; }
        .data-table { width: 100%; border-collapse: collapse; }
        .data-table td { border: 1px solid #ccc; padding: 0.5rem; vertical-align: top; }
    """
_VIEWER = """
    (async () => {
      const raw = Uint8Array.from(atob(document.currentScript?.dataset.pdf ?? window.pdfContent), c => c.charCodeAt(0));
      const pdf = await pdfjsLib.getDocument({ data: raw }).promise;
      const canvas = document.getElementById("pdf-canvas"), at = document.getElementById("current-page");
      document.getElementById("total-pages").textContent = pdf.numPages;
      let now = 1;
      window.showPage = async step => {
        now = Math.min(pdf.numPages, Math.max(1, now + step));
        const page = await pdf.getPage(now), viewport = page.getViewport({ scale: 1.5 });
        canvas.width = viewport.width; canvas.height = viewport.height;
        await page.render({ canvasContext: canvas.getContext("2d"), viewport }).promise;
        at.textContent = now;
      };
      window.showPage(0);
    })();
"""


def _text(*parts) -> Column:
    return F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))


def _px(x: Column) -> Column:
    return _text(css_number(x), "pt")


def _placed(bounds: Column) -> Column:
    return _text("position: absolute; left: ", _px(bounds["x"]), "; top: ", _px(bounds["y"]), "; width: ", _px(bounds["width"]), "; height: ", _px(bounds["height"]), ";")


def _has_place(bounds: Column) -> Column:
    return (bounds["width"] > 0) & (bounds["height"] > 0)


def render_run(run: Column) -> Column:
    s = run["style"]
    html = html_escape(run["text"])
    for flag, tag in (("bold", "strong"), ("italic", "em"), ("underline", "u"), ("strikethrough", "s")):
        html = F.when(s[flag], _text(f"<{tag}>", html, f"</{tag}>")).otherwise(html)
    css = F.filter(
        F.array(
            _text("font-family: ", html_escape(s["font_family"])),
            _text("font-size: ", _px(s["font_size"])),
            _text("color: ", html_escape(s["color"])),
            _text("background-color: ", html_escape(s["background_color"])),
        ),
        lambda x: x.isNotNull(),
    )
    return F.when(F.size(css) > 0, _text('<span style="', F.array_join(css, "; "), '">', html, "</span>")).otherwise(html)


def _is_viewer(runs: Column) -> Column:
    return (F.size(runs) == 1) & F.startswith(F.get(runs, F.lit(0))["text"], F.lit(MARKER))


def render_viewer(runs: Column) -> Column:
    data = F.substring(F.get(runs, F.lit(0))["text"], F.lit(len(MARKER) + 1), F.length(F.get(runs, F.lit(0))["text"]))
    return _text(
        '<div class="pdf-viewer-container"><canvas id="pdf-canvas"></canvas><div class="pdf-controls"><button onclick="showPage(-1)">Previous</button>'
        ' <span id="page-info">Page <span id="current-page">1</span> of <span id="total-pages">1</span></span> <button onclick="showPage(1)">Next</button></div>'
        "<script src=\"https://cdnjs.cloudflare.com/ajax/libs/pdf.js/3.11.174/pdf.min.js\"></script><script>window.pdfContent = '",
        data,
        "';",
        _VIEWER,
        "</script></div>",
    )


def render_text(block: Column) -> Column:
    place = F.when(_has_place(block["bounds"]), _placed(block["bounds"])).otherwise("position: relative; margin-bottom: 1em;")
    turn = F.when(block["rotation"] != 0, _text("transform: rotate(", css_number(block["rotation"]), "deg); transform-origin: center;")).otherwise("")
    shape = F.filter(
        F.array(
            _text("background-color: ", html_escape(block["fill_color"]), ";"),
            _text("border: ", _px(F.coalesce(block["stroke_width"], F.lit(1.0))), " solid ", html_escape(block["stroke_color"]), ";"),
        ),
        lambda x: x.isNotNull(),
    )
    runs = F.array_join(F.transform(block["runs"], render_run), "")
    return _text('<div class="text-content" style="', place, " ", turn, " ", F.array_join(shape, " "), '">', runs, "</div>")


def render_table(block: Column) -> Column:
    def spans(cell: Column) -> Column:
        return F.concat(*(F.when(cell[f] > 1, _text(f' {name}="', cell[f].cast("string"), '"')).otherwise("") for f, name in (("col_span", "colspan"), ("row_span", "rowspan"))))

    def one(cell: Column) -> Column:
        content = F.array_join(F.transform(cell["content"], lambda runs: F.array_join(F.transform(runs, lambda r: html_escape(r["text"])), "")), "")
        return _text("<td", spans(cell), ">", content, "</td>")

    rows = F.transform(block["rows"], lambda r: _text("<tr>", F.array_join(F.transform(r, one), ""), "</tr>"))
    html = _text('<table class="data-table">', F.array_join(rows, ""), "</table>")
    return F.when(_has_place(block["bounds"]), _text('<div style="', _placed(block["bounds"]), '">', html, "</div>")).otherwise(html)


def image_tag(found: Column, mime: Column, data: Column, alt: Column) -> Column:
    tag = _text('<img src="data:', html_escape(mime), ";base64,", base64_plain(data), '" alt="', html_escape(F.coalesce(alt, F.lit("Image"))), '" style="width: 100%; height: 100%;" />')
    return F.when(~found, "<p><em>[Image not found]</em></p>").when(data.isNull(), "<p><em>[Image data missing]</em></p>").otherwise(tag)


def _opened(kind: str, bounds: Column) -> Column:
    return F.when(_has_place(bounds), _text(f'<div class="{kind}" style="', _placed(bounds), '">')).otherwise(f'<div class="{kind}">')


def _boxed(kind: str, bounds: Column, html: Column) -> Column:
    return _text(_opened(kind, bounds), html, "</div>")


def _image_of(images: Column, resource_id: Column) -> Column:
    """The first image of that id, or null."""
    return F.get(F.filter(images, lambda i: i["id"] == resource_id), F.lit(0))


def render_image(block: Column, images: Column) -> Column:
    image = _image_of(images, block["resource_id"])
    return _boxed("image-container", block["bounds"], image_tag(image.isNotNull(), image["mime_type"], image["data"], block["alt_text"]))


def render_vector(block: Column) -> Column:
    def path(p: Column) -> Column:
        commands = F.transform(p["commands"], lambda c: F.array_join(F.concat(F.array(c["op"]), F.transform(c["points"], css_number)), " "))
        return _text('<path d="', F.array_join(commands, " "), '" fill="', html_escape(F.coalesce(p["fill"], F.lit("none"))), '" stroke="', html_escape(F.coalesce(p["stroke"], F.lit("none"))), '" stroke-width="', css_number(F.coalesce(p["stroke_width"], F.lit(0.0))), '" />')

    box = _text('<svg viewBox="0 0 ', css_number(block["bounds"]["width"]), " ", css_number(block["bounds"]["height"]), '" width="100%" height="100%" preserveAspectRatio="none">', F.array_join(F.transform(block["paths"], path), ""), "</svg>")
    return _boxed("vector-block", block["bounds"], box)


def render_block(block: Column, images: Column) -> Column:
    kind = block["kind"]
    return (
        F.when((kind == "Text") & _is_viewer(block["runs"]), render_viewer(block["runs"]))
        .when(kind == "Text", render_text(block))
        .when(kind == "Image", render_image(block, images))
        .when(kind == "Table", render_table(block))
        .when(kind == "Vector", render_vector(block))
        .when(kind == "Container", _opened("container-block", block["bounds"]))
        .otherwise("")
    )


def render_blocks(blocks: Column, images: Column) -> Column:
    """Blocks in order, with containers around what is inside them: after each block as many end as the next block's depth
    asks for, and siblings are parted by line feeds."""
    depth = lambda i: F.coalesce(F.get(blocks, i)["depth"], F.lit(0))

    def one(block: Column, i: Column) -> Column:
        first = (i == 0) | (depth(i - 1) < depth(i))
        ends = depth(i) + (block["kind"] == "Container").cast("int") - depth(i + 1)
        return _text(F.when(first, "").otherwise("\n"), render_block(block, images), F.repeat(F.lit("</div>"), F.greatest(ends, F.lit(0))))

    return F.array_join(F.transform(blocks, one), "")


def render_container(bounds: Column, children: Column) -> Column:
    return _boxed("container-block", bounds, F.array_join(children, "\n"))


def render_containers(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """blocks: keys, block_path (ordinals from the top), is_container, bounds, html (of what is no container). Containers
    are closed from the deepest level up, one aggregation a level; rows of the top level, with html, come back."""
    depth = blocks.agg(F.max(F.size("block_path"))).first()[0] or 1
    done = blocks.where(F.size("block_path") == depth)
    for level in range(depth, 0, -1):
        done = done.withColumn("html", F.when(F.col("is_container"), render_container(F.col("bounds"), F.coalesce("children", F.array().cast("array<string>")) if "children" in done.columns else F.array().cast("array<string>"))).otherwise(F.col("html")))
        if level == 1:
            break
        parts = F.array_sort(F.collect_list(F.struct(F.element_at("block_path", -1).alias("o"), "html")))
        children = done.groupBy(*keys, F.slice("block_path", 1, level - 1).alias("block_path")).agg(F.transform(parts, lambda p: p["html"]).alias("children"))
        done = blocks.where(F.size("block_path") == level - 1).join(children, [*keys, "block_path"], "left")
    return done.select(*keys, "block_path", "html")


def render_page(page: Column, number: Column, images: Column) -> Column:
    first = F.get(page["blocks"], F.lit(0))
    image = _image_of(images, first["resource_id"])
    close = lambda a, b: F.abs(a - b) < NEAR
    b = first["bounds"]
    covers = (first["kind"] == "Image") & close(b["width"], page["width"]) & close(b["height"], page["height"]) & (F.abs(b["x"]) < NEAR) & (F.abs(b["y"]) < NEAR) & image["data"].isNotNull()
    covers = F.coalesce(covers, F.lit(False))
    back = F.when(covers, _text("background-image: url('data:", image["mime_type"], ";base64,", base64_plain(image["data"]), "'); background-size: cover; background-position: center;")).otherwise("background-color: white;")
    shown = F.filter(page["blocks"], lambda _, i: ~(covers & (i == 0)))
    content = render_blocks(shown, images)
    return _text('<div class="page" style="width: ', _px(page["width"]), "; height: ", _px(page["height"]), "; position: relative; overflow: hidden; ", back, '">\n        <div class="page-number" style="display: none;">Page ', number.cast("string"), "</div>\n        ", content, "\n    </div>")


def has_viewer(page: Column) -> Column:
    only = F.get(page["blocks"], F.lit(0))
    return F.coalesce((F.size(page["blocks"]) == 1) & ((only["kind"] == "Image") | ((only["kind"] == "Text") & _is_viewer(only["runs"]))), F.lit(False))


def render_pages(document: Column) -> Column:
    pages, images = document["pages"], document["images"]
    bare = F.coalesce(F.try_element_at(document["metadata"]["custom"], F.lit("format"))["s"].isin(*PAGELESS), F.lit(False)) | ((F.size(pages) == 1) & has_viewer(F.get(pages, F.lit(0))))
    blocks = F.flatten(F.transform(pages, lambda p: p["blocks"]))
    plain = render_blocks(blocks, images)
    wrapped = F.array_join(F.transform(pages, lambda p, i: render_page(p, i + 1, images)), "\n")
    return F.when(bare, plain).otherwise(wrapped)


def html_page(title: Column, body: Column) -> Column:
    head = '<!DOCTYPE html>\n<html lang="en">\n<head>\n    <meta charset="UTF-8">\n    <meta name="viewport" content="width=device-width, initial-scale=1.0">\n    <title>'
    return _text(head, html_escape(F.coalesce(title, F.lit(UNTITLED))), f"</title>\n    <style>{_STYLE}</style>\n</head>\n<body>\n    <div class=\"container\">\n        ", body, "\n    </div>\n</body>\n</html>")


def render_document(document: Column) -> Column:
    return html_page(document["metadata"]["title"], render_pages(document))
