"""Sources and sinks: file trees, inventories, field tables, events, reports."""
