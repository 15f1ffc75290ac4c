"""Text formats of the sinks (description additions, message
attachments, dry-run plans, digest lines, lint report).  They must read
exactly like this to produce the same output text."""

# RSS/Atom item description additions
DESC_COUNT_OPEN = "\n<p>Hatena Bookmark: <b>"
DESC_COUNT_CLOSE = "</b></p>"
DESC_COMMENTS_OPEN = "\n<p><b>Comments:</b></p><ul>"
DESC_COMMENTS_CLOSE = "</ul>"
# notification message attachment
ATTACH_COUNT_OPEN = "Hatena Bookmark: *"
ATTACH_COUNT_CLOSE = "*\n"
ATTACH_COMMENTS = "Hatena Comments: "
# posting dry run
DRY_RUN_HEADER = "slack dry-run: channel=%s posts=%d"
DRY_RUN_ITEM = ". message title="
DRY_RUN_COUNT = "   hatena_bookmark_count="
DRY_RUN_COMMENTS = " comments="
# comment-delta dry run
DELTA_DRY_RUN_ITEM = "hatena dry-run: title="
DELTA_DRY_RUN_SUMMARY = "hatena dry-run summary: channel=%s parent_posts=%d comment_posts=%d"
UNSET_CHANNEL = "(unset)"
# digest
DIGEST_ITEMS = "Items: "
DIGEST_COUNT = " - Hatena Bookmark: "
# lint report
LINT_TOTALS = "feeds: total=%d valid=%d invalid=%d"
LINT_FEED_ERROR = "feed %d: %s"
