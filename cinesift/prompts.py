"""Prompts for captioning, by use case; None is for any."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .functions.text import fill

VIDEO = {
    None: "Describe what happens in this clip, first to last, in one plain paragraph. {subject}",
    "character": "Call the person {anchor}. Say what {anchor} does from first to last; leave out looks that never change. {subject}",
    "style": "Describe the action and the setting; do not name the look, which {anchor} stands for. {subject}",
    "motion": "Describe how things and the camera move, and how fast, from first to last. Call the movement {anchor}. {subject}",
    "object": "Call the object {anchor}. Say where it is and what is done with it. {subject}",
}
IMAGE = {
    None: "Describe this picture in one plain paragraph. {subject}",
    "character": "Call the person {anchor}. Describe pose, place and light. {subject}",
    "style": "Describe what is shown; do not name the look, which {anchor} stands for. {subject}",
    "motion": "Describe the moment of movement that is shown. Call the movement {anchor}. {subject}",
    "object": "Call the object {anchor}. Describe where it is and how it lies. {subject}",
}
#: Sentences whose embeddings stand for frames of overlaid text; the threshold
#: of similarity to them was chosen for these words.
OVERLAY = [
    "a movie title card with large text", "opening credits with text on a dark background", "closing credits scrolling text", "chapter title text overlay on screen", "movie poster with title text", "white text on black background",
    "end credits rolling text", "a title sequence with stylized text", "intertitle card with text",
]


def build(use_case: str | None, kind: str = "video", anchor: str = "", tags: tuple[str, ...] = (), custom: str | None = None) -> Column:
    """The prompt of one run; a custom one replaces it whole. tags: words to mention where
    they fit."""
    if custom:
        return F.lit(custom)
    text = fill(template(F.lit(use_case).cast("string"), kind), anchor=F.lit(anchor), subject=F.lit(""))
    more = " Mention these only where they are seen: " + ", ".join(f'"{t}"' for t in tags) + "." if tags else ""
    return F.concat(F.rtrim(text), F.lit(more))


def template(use_case: Column, kind: str) -> Column:
    """The template of a use case (null: any). For images an unknown one is any; for
    videos it is an error."""
    table = VIDEO if kind == "video" else IMAGE
    out = F.when(use_case.isNull(), table[None])
    for name, text in table.items():
        if name:
            out = out.when(use_case == name, text)
    return out.otherwise(F.raise_error(F.concat(F.lit("no such use case: "), use_case)) if kind == "video" else F.lit(table[None]))
