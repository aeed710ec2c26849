"""Training-data operators. Nothing outside this subpackage imports it; deleting it leaves the library whole."""
