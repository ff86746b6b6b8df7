"""Reading landed files, writing results, and keeping account of both."""
