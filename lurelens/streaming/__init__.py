"""The same jobs on streams: intake, repeat suppression, verdict cache, status, override lookup."""
