"""Text and entity operators for preparing large corpora; nothing outside this folder imports it."""
