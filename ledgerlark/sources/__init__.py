"""Tables, readers and sinks."""
