"""State of one key in memory, for stateful processors without a stream."""


class MapOfOne:
    """A map state of one key that counts what is written."""

    def __init__(self):
        self.held, self.writes = {}, 0

    def iterator(self):
        return iter([((k,), (v,)) for k, v in self.held.items()])

    def updateValue(self, key, value):
        self.held[key[0]], self.writes = value[0], self.writes + 1

    def removeKey(self, key):
        del self.held[key[0]]
        self.writes += 1


class ValueOfOne:
    value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


class HandleOfOne:
    def getMapState(self, *_):
        return MapOfOne()

    def getValueState(self, *_):
        return ValueOfOne()
