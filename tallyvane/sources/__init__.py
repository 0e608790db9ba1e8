"""Configuration, document and index sources and sinks."""
