"""String functions: JSON Pointer, ECMAScript regular expressions, formats, Punycode and internationalised domain names."""
