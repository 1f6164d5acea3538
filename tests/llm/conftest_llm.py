LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
