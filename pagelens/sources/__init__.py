"""Where documents come from: inline markup, files, byte regions of files."""
