"""Sources and sinks: adapters to the logical model, text artifacts, transcripts, file trees."""
