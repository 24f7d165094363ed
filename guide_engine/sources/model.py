"""The guide document's grammar as data: one table drives both the reader and the writer."""

from __future__ import annotations

from ..functions.text import escape

#: element -> (field, kind, repeats). Written in this order.
PROGRAMME = [
    ("title", "title", "text", True), ("sub-title", "sub_title", "text", True), ("desc", "desc", "text", True), ("credits", "credits", "credits", False),
    ("date", "date", "date", False), ("category", "category", "text", True), ("keyword", "keyword", "text", True), ("language", "language", "text", False),
    ("orig-language", "orig_language", "text", False), ("length", "length", "length", False), ("icon", "icon", "icon", True), ("url", "url", "url", True),
    ("country", "country", "text", True), ("episode-num", "episode_num", "episode", True), ("video", "video", "video", False), ("audio", "audio", "audio", False),
    ("previously-shown", "previously_shown", "shown", False), ("premiere", "premiere", "flag", False), ("last-chance", "last_chance", "flag", False), ("new", "is_new", "new", False),
    ("subtitles", "subtitles", "subtitles", True), ("rating", "rating", "rating", True), ("star-rating", "star_rating", "rating", True), ("review", "review", "review", True), ("image", "image", "image", True),
]
CHANNEL = [("display-name", "display_name", "text", True), ("icon", "icon", "icon", True), ("url", "url", "url", True)]
ROLES = ("director", "actor", "writer", "adapter", "producer", "composer", "editor", "presenter", "commentator", "guest")
#: kind -> its attributes (xml name, field, type)
ATTRIBUTES = {
    "text": [("lang", "lang", "string")], "url": [("system", "system", "string")], "icon": [("src", "src", "string"), ("width", "width", "number"), ("height", "height", "number")],
    "episode": [("system", "system", "string")], "image": [("type", "type", "image-type"), ("size", "size", "image-size"), ("orient", "orient", "orient"), ("system", "system", "string")],
    "length": [("units", "units", "units")], "shown": [("start", "start", "date"), ("channel", "channel", "string")], "subtitles": [("type", "type", "subtitles-type")],
    "rating": [("system", "system", "string")], "review": [("type", "type", "review-type"), ("source", "source", "string"), ("reviewer", "reviewer", "string"), ("lang", "lang", "string")],
    "actor": [("role", "role", "string"), ("guest", "guest", "yes-no")],
    "programme": [("start", "start", "date"), ("stop", "stop", "date"), ("pdc-start", "pdc_start", "date"), ("vps-start", "vps_start", "date"), ("showview", "showview", "string"), ("videoplus", "videoplus", "string"), ("channel", "channel", "string"), ("clumpidx", "clumpidx", "string")],
    "channel": [("id", "id", "string")],
    "meta": [("date", "date", "date"), ("source-info-name", "source_info_name", "string"), ("source-info-url", "source_info_url", "string"), ("source-data-url", "source_data_url", "string"), ("generator-info-name", "generator_info_name", "string"), ("generator-info-url", "generator_info_url", "string")],
}
#: Fixed values of the document type.
CHOICES = {
    "image-type": ("poster", "backdrop", "still", "person", "character"), "image-size": ("1", "2", "3"), "orient": ("P", "L"), "units": ("seconds", "minutes", "hours"),
    "subtitles-type": ("teletext", "onscreen", "deaf-signed"), "review-type": ("text", "url"),
}


def number_text(x: float) -> str:
    return str(int(x)) if float(x).is_integer() else repr(float(x))


def attr(name: str, value) -> str:
    return "" if value is None else f' {name}="{escape(str(value))}"'
