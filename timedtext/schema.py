"""Relations, all keyed by video_id.  Times are seconds from the start of the source."""

CUES = "video_id string, ordinal int, start double, end double, text string"
FRAMES = "video_id string, ordinal int, ts double, path string"
PAGE_FIELDS = (
    "number int, title string, start double, end double, summary string, bullets array<string>, takeaway string, "
    "frame_path string, source_text string, kind string, chapter string, uncertainty string"
)
PAGES = f"video_id string, {PAGE_FIELDS}"
SUMMARIES = "video_id string, page_id int, title string, summary string, bullets array<string>, takeaway string, chapter string, uncertainty string, evidence array<string>"
SOURCES = "video_id string, title string, source_url string, duration double"
FILES = "path string, value string"
TRACKS = "video_id string, code string, automatic boolean, n_tracks int"
