"""Relations of the document model, and readers and writers of packages, events and journals."""
