"""What a client asks for, parsed and validated before any DataFrame is built."""
