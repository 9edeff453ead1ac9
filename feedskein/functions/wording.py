"""Texts that results contain, as printf formats."""

# Messages.
FETCH_TIMEOUT = "Timeout fetching %s"
FETCH_STATUS = "HTTP %d fetching %s"
FETCH_FAILED = "Network error fetching %s: %s"
MALFORMED = "Malformed feed content from %s"
ERROR = "Error: %s"
SUBSCRIBED = "Error: Already subscribed to %s"
NOTHING_FOUND = "No RSS or Atom feeds found at %s. Try a direct feed URL."
NO_FEEDS = "No feeds subscribed. Press 'a' to add one."
FETCHED = "Fetched %d new article(s)"
FETCHES_FAILED = " (%d feed(s) failed)"
TOO_MANY_REDIRECTS = "Exceeded maximum allowed redirects."

# Labels, marks and formats of lists.
ALL_FEEDS = "All Feeds"
FAVORITES = "★ Favorites"
FEED_LABEL = "%s (%d)"
UNREAD = "●"
STAR = "★"
UNTITLED = "Untitled"
NO_CONTENT = "(no content)"
META_SEPARATOR = " | "
LINK_LINE = "[%d] %s (%s)"
DAY = "yyyy-MM-dd"
MINUTE = "yyyy-MM-dd HH:mm"

# Our own.
NOT_CAPTURED = "not captured"
SEVERAL_FOUND = "%d feeds found"
